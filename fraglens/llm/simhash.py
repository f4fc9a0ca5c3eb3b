"""SimHash near-duplicates found by the generalised pigeonhole principle.

Bits that go together are grouped into partitions. Fingerprints within tau bits of each other are within t_i bits
on some partition i whenever the sum of (t_i + 1) is tau + 1; the t_i (-1: never probed) are allocated by dynamic
programming on candidate counts that are estimated from the histograms of all fingerprints. Each fingerprint is
dealt to the cells of its partition values (and those within t_i bits), and what meets in a cell is verified there.
near_copies() takes its first candidates from these cells, judges them by the Jaccard similarity of shingles, and has
a prefix filter find every pair that the fingerprints leave out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fraglens.llm.common import bounds, discard, forest, materialise, slim, tune, whole_groups
from fraglens.llm.components import connected_components

BITS, GROUPS = 64, 4
SEED = 42
#: Fingerprints that one cell holds before it is dealt out in blocks.
BLOCK = 2048
#: Cost of a dealt row in comparisons.
ROW_COST = 30


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) runs of characters between ASCII white space."""
    return text.encode().lower().split()


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Runs of `width` words joined by spaces, repeats included; the whole if there are fewer words."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
    return [joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def _votes(features: list[list[bytes]]) -> np.ndarray:
    """The fingerprint (unsigned) of each list of features: bits set in over half of their XXH64."""
    out = np.zeros(len(features), dtype=np.uint64)
    sizes = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    digest = xxhash.xxh64_digest
    at = 0
    while at < len(features):  # up to so many features at once: 64 bytes each
        top = at + 1
        n = int(sizes[at])
        while top < len(features) and n + sizes[top] <= 200_000:
            n += int(sizes[top])
            top += 1
        have = np.flatnonzero(sizes[at:top]) + at
        if len(have):
            raw = np.frombuffer(b"".join([digest(f, SEED) for i in have for f in features[i]]), dtype=np.uint8).reshape(-1, 8)
            cuts = np.cumsum(sizes[have]) - sizes[have]
            counts = np.add.reduceat(np.unpackbits(raw, axis=1), cuts, axis=0, dtype=np.int32)
            out[have] = np.packbits(2 * counts > sizes[have][:, None], axis=1).view(">u8").ravel()
        at = top
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (signed long) of each row of docs (doc_id, text), over runs of `width` words."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 100):
                fp = _votes([shingles(words_of(t or ""), width) for t in texts[at : at + 100]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 100), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_groups(fps: DataFrame, column: str = "fp") -> list[list[int]]:
    """The bits in GROUPS equal groups; each takes the bits that correlate most with those that it has."""

    def run(batches):
        both = np.zeros((BITS + 1, BITS + 1), dtype=np.int64)
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
            both += np.rint(x.T @ x).astype(np.int64)
        i, j = np.indices(both.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(both.ravel(), pa.int64())], ["i", "j", "n"])

    both = np.zeros((BITS + 1, BITS + 1))
    for r in fps.select(column).mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # one row for each pair of bits
        both[r.i, r.j] = r.n
    n = max(1.0, both[BITS, BITS])
    p = both[BITS, :BITS] / n
    cov = both[:BITS, :BITS] / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, out = list(range(BITS)), []
    for _ in range(GROUPS):
        sub = corr[np.ix_(left, left)].sum(axis=1)
        own = [left.pop(int(np.argmax(sub)))]
        while len(own) < BITS // GROUPS:
            own.append(left.pop(int(np.argmax(corr[np.ix_(left, own)].sum(axis=1)))))
        out.append(sorted(own))
    return out


def gathered(fp: str | Column, bits: list[int]) -> Column:
    """The value of these bits of fp."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.shiftright(fp, b).bitwiseAND(F.lit(1)), k) for k, b in enumerate(bits)))


def distances(counts: np.ndarray, most: int) -> np.ndarray:
    """Ordered pairs at each distance 0..most of values with these counts (length a power of two)."""
    f = counts.astype(float)
    n = len(f)
    h = 1
    while h < n:
        f = f.reshape(-1, 2, h)
        f = np.stack([f[:, 0] + f[:, 1], f[:, 0] - f[:, 1]], axis=1).reshape(-1)
        h *= 2
    f = f * f
    h = 1
    while h < n:
        f = f.reshape(-1, 2, h)
        f = np.stack([f[:, 0] + f[:, 1], f[:, 0] - f[:, 1]], axis=1).reshape(-1)
        h *= 2
    ones = np.bitwise_count(np.arange(n, dtype=np.uint32))
    return np.bincount(ones, weights=np.maximum(f / n, 0), minlength=most + 1)[: most + 1]


def allocate(tau: int, groups: list[list[int]], pairs: list[np.ndarray], n: float) -> list[tuple[list[int], int]]:
    """The partitions (unions of bit groups) and thresholds with the least estimated cost.

    pairs[g][d]: ordered pairs at distance d on group g. Groups in one partition count as independent.
    """
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    rate = [np.asarray(p) / max(1.0, n * n) for p in pairs]
    for layout in ([[0], [1], [2], [3]], [[0, 1], [2], [3]], [[0, 1], [2, 3]]):
        cost = []
        for part in layout:
            dist = np.zeros(tau + 1)
            dist[0] = 1
            for g in part:
                dist = np.convolve(dist, np.pad(rate[g], (0, max(0, tau + 1 - len(rate[g])))))[: tau + 1]
            width = sum(len(groups[g]) for g in part)
            reach = np.cumsum(dist) * n * n / 2
            cost.append([0.0] + [reach[t] + ROW_COST * n * _rows(width, t) for t in range(tau + 1)])
        # cost[i][k]: partition i with threshold k - 1; the k sum to tau + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (x, ks) in table.items():
                for k in range(tau + 2 - s):
                    if s + k not in new or x + c[k] < new[s + k][0]:
                        new[s + k] = (x + c[k], [*ks, k])
            table = new
        x, ks = table[tau + 1]
        if best is None or x < best[0]:
            best = x, [([b for g in part for b in groups[g]], k - 1) for part, k in zip(layout, ks, strict=True) if k]
    return best[1]


def _rows(width: int, t: int) -> int:
    """Rows that a fingerprint is dealt as: its own value, and those within t bits."""
    return sum(comb(width, k) for k in range(t + 1))


def thresholds(fps: DataFrame, tau: int, column: str = "fp") -> list[tuple[list[int], int]]:
    groups = bit_groups(fps, column)
    values = F.explode(F.array(*(F.struct(F.lit(g).alias("g"), gathered(column, bits).alias("value")) for g, bits in enumerate(groups)))).alias("x")
    seen = fps.select(values).groupBy("x.g", "x.value").count().toPandas()  # at most GROUPS * 2^16 rows
    pairs = []
    for g, bits in enumerate(groups):
        own = seen[seen.g == g]
        counts = np.zeros(1 << len(bits))
        counts[own.value.to_numpy(dtype=np.int64)] = own["count"].to_numpy()
        pairs.append(distances(counts, tau))
    return allocate(tau, groups, pairs, float(seen["count"].sum()) / GROUPS)


def deal(fps: DataFrame, parts: list[tuple[list[int], int]], column: str = "fp") -> DataFrame:
    """fps with cell and probe: a row for each partition (probe false) and each value within its threshold (true).

    Cells with over BLOCK rows are dealt in blocks, each pair of which meets once (columns bi, bj).
    """
    cells = []
    for k, (bits, t) in enumerate(parts):
        own = gathered(column, bits)
        masks = [sum(1 << b for b in c) for r in range(1, t + 1) for c in combinations(range(len(bits)), r)]
        tag = F.lit(k << 40)
        cells.append(F.array(F.struct((own + tag).alias("cell"), F.lit(False).alias("probe"))))
        if masks:
            cells.append(F.transform(F.array(*map(F.lit, masks)).cast("array<long>"), _probe(own, tag)))
    dealt = fps.select(*fps.columns, F.explode(F.concat(*cells)).alias("to")).select(*fps.columns, "to.cell", "to.probe")
    full = dealt.groupBy("cell").count().where(F.col("count") > BLOCK)
    n = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(column, F.lit(7)), n).cast("int")
    blocks = F.when(F.col("count").isNull(), F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj")))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(own, j).alias("bi"), F.greatest(own, j).alias("bj"))))
    return dealt.join(full, "cell", "left").select(*fps.columns, "cell", "probe", F.explode(blocks).alias("b")).select(*fps.columns, "cell", "probe", "b.bi", "b.bj")


def _probe(own: Column, tag: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct((own.bitwiseXOR(mask) + tag).alias("cell"), F.lit(True).alias("probe"))


def close_pairs(cell: np.ndarray, probe: np.ndarray, *tests: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs in one cell, not both probes, whose fingerprints pass each test (fingerprints, most bits)."""
    cuts = bounds(cell)
    end = np.repeat(cuts[1:], np.diff(cuts))
    at = np.arange(len(cell))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        ok = ~(probe[at] & probe[at + step])
        for fp, most in tests:
            ok &= np.bitwise_count(fp[at] ^ fp[at + step]) <= most
        if ok.any():
            found.append((at[ok], at[ok] + step))
        step += 1
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _in_cells(dealt: DataFrame, columns: list[str], link: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(u, v): the node pairs that link() finds among the rows of each cell."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["cell", "bi", "bj"]):
            x = {c: table.column(c).to_numpy() for c in [*columns, "cell", "probe", "bi", "bj"]}
            group = np.cumsum(np.concatenate([[0], (x["cell"][1:] != x["cell"][:-1]) | (x["bi"][1:] != x["bi"][:-1]) | (x["bj"][1:] != x["bj"][:-1])]))
            u, v = link(x | {"cell": group})
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(*columns, "cell", "probe", "bi", "bj").repartition(n, "cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj").mapInArrow(run, "u long, v long")


def link_fingerprints(fps: DataFrame, tau: int) -> DataFrame:
    """(u, v) edges that connect the nodes (fps: fp, node; fp unique) within tau bits; a spanning forest per cell."""

    def link(x):
        fp, node = x["fp"], x["node"]
        a, b = close_pairs(x["cell"], x["probe"], (fp, tau))
        used, index = np.unique(node[np.concatenate([a, b])], return_inverse=True)
        root = forest(index[: len(a)], index[len(a) :], len(used))
        return used, used[root]

    return _in_cells(deal(fps, thresholds(fps, tau)), ["fp", "node"], link).where("u <> v")


def _best(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v) with repeats, for each end the one that occurs most often: as many as there are ends at most."""
    counted = pairs.groupBy("u", "v").count()
    ends = F.explode(F.array(F.struct(F.col("u").alias("end"), F.col("v").alias("other")), F.struct(F.col("v").alias("end"), F.col("u").alias("other")))).alias("e")
    best = counted.select(ends, "count").groupBy("e.end").agg(F.max(F.struct("count", "e.other")).alias("best")).select("end", "best.other")
    return best.select(F.least("end", "other").alias("u"), F.greatest("end", "other").alias("v")).distinct()


def close_neighbours(fps: DataFrame, tau: int) -> DataFrame:
    """(u, v), u < v: nodes (fps: fp, node) that have one fingerprint, or within tau bits of each other's; twice as many as nodes at most."""
    own = materialise(fps.groupBy("fp").agg(F.min("node").alias("node")))
    equal = fps.join(own.withColumnRenamed("node", "low"), "fp").where("node > low").select(F.col("low").alias("u"), F.col("node").alias("v"))

    def link(x):
        fp, node = x["fp"], x["node"]
        a, b = close_pairs(x["cell"], x["probe"], (fp, tau))
        order = np.lexsort((np.bitwise_count(fp[a] ^ fp[b]), b))  # each with the closest of those before it
        a, b = a[order], b[order]
        first = bounds(b)[:-1] if len(b) else b
        u, v = node[a[first]], node[b[first]]
        return np.minimum(u, v), np.maximum(u, v)

    return equal.unionByName(_best(_in_cells(deal(own, thresholds(own, tau)), ["fp", "node"], link).where("u <> v")))


def simhash_components(docs: DataFrame, width: int = 3, tau: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs (doc_id, text).

    Texts are lower-cased (A-Z) and split at ASCII white space; a null or empty text has fingerprint zero and links
    like any other. Fingerprints within tau bits link; component_id is the smallest doc_id reachable. Equal
    fingerprints are one node, so groups of copies cost nothing. Rows with a null doc_id keep their row and link,
    but name no component: if a fingerprint has only such rows, it links with nothing and has a null component.
    """
    own = materialise(fingerprints(docs, width))
    nodes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("node")))
    edges = link_fingerprints(nodes.where("node is not null"), tau)
    roots = connected_components(edges)
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Documents whose shingles are counted to put common ones last; only the order depends on it, never the result.
ORDER_DOCS, COMMON = 8192, 65536
#: Pairs of a prefix shingle, per row, that are all compared at once; where there are more, so many chains of neighbours come first.
PAIRS_PER_ROW, CHAINS = 16, 6
#: Shingles' lists are dealt to so many shares; a round takes the next of these numbers of them, so that its pairs join most of a group before others are looked at.
SHARES, ROUNDS = 16, (1, 3, 12)
#: Pairs that a task compares at once.
PART = 1 << 16
#: Words of a run in the fingerprints of near_copies(), and bits within which they propose pairs (as in simhash_components).
FP_WIDTH, TAU = 3, 3
#: Spots of a bitmap: a power of two, about the number of shingles, between these.
SPOTS, MOST_SPOTS = 1024, 1 << 14
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29), np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a text without words has one of its own."""
    words = words_of(text or "")
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - width + 1)
    h = np.full(n, len(w) if len(w) < width else width, dtype=np.uint64)
    for k in range(min(width, len(w))):
        h = (h ^ (h >> _MIX[2])) * _MIX[0] + w[k : k + n]
        h = (h ^ (h >> _MIX[3])) * _MIX[1]
    return np.unique(h ^ (h >> _MIX[2])).view(np.int64)


def prefix(have: np.ndarray, common: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of which sets of at least this Jaccard similarity share one: the first in a fixed order, rare ones first."""
    rank = np.zeros(len(have), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, have), len(common) - 1)
        rank = np.where(common[at] == have, often[at], 0)
    return have[np.lexsort((have, rank))][: len(have) - int(np.ceil(similarity * len(have) - 1e-9)) + 1]


def _bitmap(have: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each spot: two sets differ by at least as many shingles as spots."""
    spots = min(MOST_SPOTS, max(SPOTS, 1 << (len(have) - 1).bit_length()))
    return np.packbits(np.bincount(have & (spots - 1), minlength=spots) & 1).tobytes()


def _differ(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """At how many spots the bitmaps a[i] and b[i] differ; the halves of the larger one are folded to the smaller one's size."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], dtype=np.int64).reshape(-1, 2)
    out = np.zeros(len(a), dtype=np.int64)
    for kind in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == kind).all(axis=1))
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([c[i] for i in at]), dtype=np.uint64).reshape(len(at), -1, kind.min() // 8), axis=1) for c in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ORDER_DOCS documents have (sorted), and how many of them have each."""
    part = max(1, docs.count() // ORDER_DOCS)

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, width))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0).select("text").mapInArrow(run, "h long")
    top = sample.groupBy("h").count().where("count > 3").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = top.column("h").to_numpy(), top.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _across(x: dict[str, np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs in one cell with different labels that may reach the similarity, a part at a time; x is sorted by token, label.

    Sets that first share the tokens at pos i and j share at most what either has from there on, so others are left
    out. So are pairs that also meet in the cell of the token before (prev).
    """
    token, label, size, pos, prev = (x[c] for c in ("token", "label", "size", "pos", "prev"))
    cells = bounds(token)
    end = np.repeat(cells[1:], np.diff(cells))
    runs = bounds(_runs(x))
    start = np.repeat(runs[1:], np.diff(runs))  # one label's rows are never compared with each other
    total = np.cumsum(end - start)
    at = 0
    while at < len(token):
        top = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PART, side="right")))
        many = end[at:top] - start[at:top]
        a = np.repeat(np.arange(at, top), many)
        b = start[a] + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        ok = np.minimum(size[a] - pos[a], size[b] - pos[b]) >= similarity / (1 + similarity) * (size[a] + size[b]) - 1e-9
        ok &= (pos[a] == 0) | (pos[b] == 0) | (prev[a] != prev[b])
        if ok.any():
            yield a[ok], b[ok]
        at = top


def _runs(x: dict[str, np.ndarray]) -> np.ndarray:
    """The number of each row's run of equal token and label."""
    return np.cumsum(np.concatenate([[False], (x["token"][1:] != x["token"][:-1]) | (x["label"][1:] != x["label"][:-1])]))


def _most(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """By how many shingles the sets a[i] and b[i] of this similarity differ at most."""
    return (1 - similarity) / (1 + similarity) * (x["size"][a] + x["size"][b]) + 1e-9


def _partnered(x: dict[str, np.ndarray], bitmaps: np.ndarray, heads: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each row is in a pair of _across() whose bitmaps allow the similarity and that shares no token before this one.

    heads: the tokens of each row's prefix before its own. A pair shares its first token in one cell only.
    """
    keep = np.zeros(len(bitmaps), dtype=bool)
    known: dict[int, frozenset[int]] = {}

    def head(k: int) -> frozenset[int]:
        if k not in known:
            known[k] = frozenset(heads[k].tolist())
        return known[k]

    for every in _across(x, similarity):
        for at in range(0, len(every[0]), PART >> 3):
            a, b = (e[at : at + (PART >> 3)] for e in every)
            new = ~(keep[a] & keep[b])
            a, b = a[new], b[new]
            ok = _differ(bitmaps[a].tolist(), bitmaps[b].tolist()) <= _most(x, a, b, similarity)
            for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                if not (keep[i] and keep[j]) and head(i).isdisjoint(head(j)):
                    keep[i] = keep[j] = True
    return keep


def _joining(x: dict[str, np.ndarray], bitmaps: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows whose sets have the similarity: as many as join all labels of a cell that such pairs of _across() join.

    Every pair is compared unless others have joined it; neighbours come first, by size and in orders of their own.
    """
    run = _runs(x)
    root = np.arange(run[-1] + 1)
    found: list[tuple[int, int]] = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        apart = root[run[a]] != root[run[b]]
        a, b = a[apart], b[apart]
        differ = _differ(bitmaps[a].tolist(), bitmaps[b].tolist())
        ok = differ <= _most(x, a, b, similarity)
        a, b, share = a[ok], b[ok], (differ / (x["size"][a] + x["size"][b]))[ok]
        order = np.argsort(share, kind="stable")  # the closest first
        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            p, q = find(run[i]), find(run[j])
            if p == q:
                continue
            both = np.sort(np.concatenate([sets[i], sets[j]]))
            n = int(np.count_nonzero(both[1:] == both[:-1]))
            if n >= similarity * (len(both) - n):
                root[max(p, q)] = min(p, q)
                found.append((i, j))
        while not np.array_equal(root, root[root]):
            root[:] = root[root]

    many = np.diff(bounds(x["token"]))
    if (many * many).sum() > 2 * PAIRS_PER_ROW * len(run):
        for chain in range(CHAINS):
            mixed = x["size"] if chain == 0 else (x["node"].astype(np.uint64) * _MIX[0] + np.uint64(chain)) * _MIX[1] >> _MIX[2]
            order = np.lexsort((x["node"], mixed, x["token"]))
            a, b = order[:-1], order[1:]
            same = x["token"][a] == x["token"][b]
            compare(a[same], b[same])
    order = np.lexsort((root[run], x["token"]))
    for every in _across({c: v[order] for c, v in (x | {"label": root[run]}).items()}, similarity):
        for at in range(0, len(every[0]), PART >> 3):
            compare(*(order[e[at : at + (PART >> 3)]] for e in every))
    out = np.array(found, dtype=np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, root) of docs (doc_id, text) in a group of near copies of more than one text; doc_id is unique.

    Texts link when the Jaccard similarity of their sets of `width`-word shingles is at least `similarity`. Sets this
    similar share a shingle among the first n - ceil(similarity * n) + 1 of each one's n in any fixed order, so pairs
    that share none there can be left out without loss, and so can those whose bitmaps differ too much. Pairs whose
    SimHash fingerprints meet in a cell and are within TAU bits are verified first. Then, so that none is lost that the
    fingerprints leave out, every pair between texts still apart is compared in the shingles' lists, by place in the
    prefix, by bitmap and by the hashes of its shingles, where it shares its first one. A list gives no more pairs than join its
    texts, and all that it gives have the similarity. The lists are taken in rounds, a small share of them first, and a round compares only
    what those before have left apart; so pairs grow with the texts, not with their groups' squares. Equal texts count as one, and so do texts without words.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    order = spark.sparkContext.broadcast(_common(docs, width))

    def prefixes(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 100):
                sets = [shingle_set(t, width) for t in texts[at : at + 100]]
                first = pa.array([prefix(s, *order.value, similarity) for s in sets], pa.list_(pa.int64()))
                fp = pa.array(_votes([shingles(words_of(t or ""), FP_WIDTH) for t in texts[at : at + 100]]).view(np.int64))
                whole = pa.array([xxhash.xxh3_128_digest((t or "").encode()) for t in texts[at : at + 100]], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 100), whole, pa.array([len(s) for s in sets], pa.int32()), pa.array(map(_bitmap, sets), pa.binary()), fp, first], ["node", "whole", "size", "bitmap", "fp", "first"])

    own = materialise(docs.mapInArrow(slim(prefixes), "node long, whole binary, size int, bitmap binary, fp long, first array<long>"))
    texts = materialise(own.groupBy("whole").agg(F.min("node").alias("v")))
    copies = materialise(own.select("node", "whole").join(texts, "whole").select(F.col("node").alias("u"), "v").where("u <> v"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def shared(batches):
        for table in whole_groups(batches, ["token"], rows=1 << 16):
            token = table.column("token").to_numpy()
            more = np.repeat(np.diff(bounds(token)) > 1, np.diff(bounds(token)))
            yield from table.filter(pa.array(more)).combine_chunks().to_batches()

    tokens = own.join(texts.select(F.col("v").alias("node")), "node", "left_semi").select("node", "size", "first", F.posexplode("first").alias("pos", "token"))
    tokens = tokens.select("token", "node", "size", "pos", F.coalesce(F.get("first", F.col("pos") - 1), F.lit(0)).alias("prev"))
    cells = materialise(tokens.repartition(n, "token").sortWithinPartitions("token").mapInArrow(slim(shared), "token long, node long, size int, pos int, prev long"))
    nodes = cells.select("node").distinct()
    bitmaps = materialise(own.select("node", "size", "bitmap", "fp").join(nodes, "node", "left_semi"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        """The texts of the nodes (node), and others by chance, without moving those of all documents."""
        spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20))
        asked = nodes.select(spot("node").alias("s")).distinct().toArrow()  # at most 2^20 rows
        mask = np.zeros(1 << 20, dtype=bool)
        mask[asked.column("s").to_numpy()] = True
        known = spark.sparkContext.broadcast(mask)

        def run(batches):
            for b in batches:
                yield b.select(["doc_id", "text"]).filter(pa.array(known.value[b.column("s").to_numpy()]))

        return docs.select("doc_id", "text", spot("doc_id").alias("s")).mapInArrow(run, docs.schema)

    def verify(batches):
        for batch in batches:
            keep = []
            for texts in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = (set(shingles(words_of(t or ""), width)) for t in texts)
                keep.append(len(x & y) >= similarity * len(x | y))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def alike(batches):
        for batch in batches:
            differ = _differ(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            most = (1 - similarity) / (1 + similarity) * (batch.column("m").to_numpy() + batch.column("n").to_numpy())
            yield batch.select(["u", "v"]).filter(pa.array(differ <= most + 1e-9))

    def verified(likely: DataFrame) -> DataFrame:
        text = texts_of(likely.select(F.col("u").alias("node")).union(likely.select("v")))
        both = likely.join(text.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u").join(text.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")
        return materialise(both.select("u", "v", "a", "b").mapInArrow(slim(verify), "u long, v long"))

    columns = ["token", "node", "size", "pos", "prev", "label"]
    numbers = lambda table: {c: table.column(c).to_numpy() for c in columns}

    def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
        column = column.combine_chunks()
        flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
        return [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def placed(batches):
        for table in whole_groups(batches, ["token"]):
            keep = np.zeros(table.num_rows, dtype=bool)
            for a, b in _across(numbers(table), similarity):
                keep[a] = keep[b] = True
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    def partnered(batches):
        for table in whole_groups(batches, ["token"]):
            keep = _partnered(numbers(table), np.array(table.column("bitmap").to_pylist(), dtype=object), lists(table.column("head")), similarity)
            yield from table.drop_columns("head").filter(pa.array(keep)).combine_chunks().to_batches()

    def hashed(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 100):
                sets = pa.array([shingle_set(t, width) for t in texts[at : at + 100]], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 100), sets], ["node", "set"])

    def joining(batches):
        for table in whole_groups(batches, ["token"], rows=512):
            x = numbers(table)
            a, b = _joining(x, np.array(table.column("bitmap").to_pylist(), dtype=object), lists(table.column("set")), similarity)
            u, v = x["node"][a], x["node"][b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    def compared(left: DataFrame) -> DataFrame:
        """Pairs that link what is apart in each list. Bitmaps go only to rows that place allows a partner, shingles only to those that bitmaps allow one."""
        grouped = lambda rows: rows.repartition(n, "token").sortWithinPartitions("token", "label")
        shape = left.select(columns).schema
        rows = materialise(grouped(left.select(columns)).mapInArrow(slim(placed), shape))
        drawn = rows.join(own.select("node", "bitmap", "first"), "node").select(*columns, "bitmap", F.slice("first", 1, F.col("pos")).alias("head"))
        close = materialise(grouped(drawn).mapInArrow(slim(partnered), StructType([*shape, *StructType.fromDDL("bitmap binary")])))
        discard(rows)
        sets = texts_of(close).mapInArrow(slim(hashed), "node long, set array<long>")
        pairs = materialise(grouped(close.join(sets, "node").select(*columns, "bitmap", "set")).mapInArrow(slim(joining), "u long, v long").distinct())
        discard(close)
        return pairs

    pairs = materialise(close_neighbours(bitmaps.select("fp", "node"), TAU))
    drawn = pairs.join(bitmaps.select(F.col("node").alias("u"), F.col("size").alias("m"), F.col("bitmap").alias("a")), "u").join(bitmaps.select(F.col("node").alias("v"), F.col("size").alias("n"), F.col("bitmap").alias("b")), "v")
    linked = verified(materialise(drawn.select("u", "v", "m", "n", "a", "b").mapInArrow(slim(alike), "u long, v long")))
    share = F.pmod(F.xxhash64("token"), F.lit(SHARES))
    done = 0
    for shares in ROUNDS:
        labels = connected_components(linked)
        left = cells.where((share >= done) & (share < done + shares)).join(labels, "node", "left").withColumn("label", F.coalesce("root", "node"))
        linked = linked.unionByName(verified(compared(left)))
        done += shares
    roots = connected_components(linked.unionByName(copies))
    discard(own)
    discard(cells)
    discard(bitmaps)
    return roots
