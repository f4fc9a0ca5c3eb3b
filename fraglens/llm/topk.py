"""Exact top-k inner products by aggregating sorted lists without random access.

Rows are dealt to blocks. A block keeps one list for each dimension, in the order of its values. Queries read all lists
from their better end, a stretch at a time, and add what they read to the sums of the rows that they meet. Bounds on
each row's score follow from what is unread: no value that is unread beats the last one read, and by Cauchy-Schwarz the
unread part is at most the product of the norms that are left. A query stops reading when few rows can still be among
its best k; only those scores are resolved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraglens.llm.common import bounds
from fraglens.llm.vectors import matrix, usable

#: Rows of a block, queries that read side by side.
BLOCK, QUERIES = 8192, 512
SCALE = 256
#: Stretches that a list is read in, the first after which bounds are drawn up, and candidates that are few.
STRETCHES, FIRST, FEW = 16, 5, 32
#: Larger numbers are resolved without bounds, since their squares could leave the range of a float.
LARGE = 1e6
_LONG = 2**63 - 1


def exact_scores(v: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products of the rows of v with q (whole numbers in double precision), without rounding."""
    if float(np.abs(v).max(initial=0)) < 2**62 / max(1.0, float(np.abs(q).max(initial=0))) / max(1, len(q)):
        return (v.astype(np.int64) @ q.astype(np.int64)).tolist()
    own = [int(x) for x in q]
    return [sum(int(x) * y for x, y in zip(r, own, strict=True)) for r in v]


class SortedLists:
    """One list per dimension of the rows v: the rows in descending order of their values."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.order = np.argsort(-v, axis=0, kind="stable").T.copy()
        self.plain = bool(np.abs(v).max(initial=0) <= LARGE)
        if self.plain:
            self.short = v.astype(np.float32)
            self.square = self.short**2
            self.norm = float(np.sqrt((v * v).sum(axis=1).max(initial=0)))
        self.reads = 0

    def candidates(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the rows that hold its best k, ties included."""
        n, dims = self.v.shape
        everything = np.arange(n)
        out: list[np.ndarray] = [everything] * len(queries)
        if n <= k + FEW or not self.plain or np.abs(queries).max(initial=0) > LARGE:
            return out
        open_ = np.arange(len(queries))
        q = queries.astype(np.float32)
        up, down = np.maximum(q, 0).T.copy(), np.minimum(q, 0).T.copy()
        total = np.zeros((n, len(q)), dtype=np.float32)
        unread_up, unread_down = np.ones((n, dims), dtype=np.float32), np.ones((n, dims), dtype=np.float32)
        cuts = np.linspace(0, n, STRETCHES + 1).astype(int)
        top, bottom = (self.short[self.order[:, i], np.arange(dims)] for i in (0, -1))
        for step in range(STRETCHES):
            a, z = cuts[step], cuts[step + 1]
            for d in range(dims):
                rows = self.order[d, a:z]
                total[rows] += self.short[rows, d][:, None] * up[d]
                unread_up[rows, d] = 0
                rows = self.order[d, n - z : n - a]
                total[rows] += self.short[rows, d][:, None] * down[d]
                unread_down[rows, d] = 0
            self.reads += (z - a) * dims * len(open_)
            if step + 1 < FIRST:
                continue
            last_up, last_down = (self.short[self.order[:, i], np.arange(dims)] for i in (z - 1, n - z))
            rest = np.sqrt(np.maximum((unread_up * self.square) @ (up > 0) + (unread_down * self.square) @ (down < 0), 0) * (unread_up @ up**2 + unread_down @ down**2))
            upper = total + np.minimum(rest, unread_up @ (last_up[:, None] * up) + unread_down @ (last_down[:, None] * down))
            lower = total + np.maximum(-rest, unread_up @ (bottom[:, None] * up) + unread_down @ (top[:, None] * down))
            slack = 1 + 1e-5 * self.norm * np.sqrt((queries[open_] ** 2).sum(axis=1))  # rounding of the short sums
            least = np.partition(lower.T.copy(), n - k, axis=1)[:, n - k] - 2 * slack
            alive = upper >= least
            done = (alive.sum(axis=0) <= k + FEW) | (step + 1 == STRETCHES)
            for i in np.flatnonzero(done):
                out[open_[i]] = everything[alive[:, i]]
            keep = np.flatnonzero(~done)
            if not len(keep):
                break
            if len(keep) < len(open_):
                open_, up, down, total = open_[keep], up[:, keep].copy(), down[:, keep].copy(), total[:, keep].copy()
        return out


def top_k(vectors: DataFrame, is_query: str, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows of vectors (vec_id, embedding) for each query row.

    is_query is a condition on vec_id. Components become floor(256 x), scores are integer inner products (one beyond
    the range of a long is ranked in double precision, and shown as the nearest long); ties go to the smaller vec_id. Rows that
    take no part: see usable(). Repeated rows are candidates for each other; fewer than k candidates give fewer rows,
    an empty table none; other columns play no part. Every query is sent to every block, whose lists are built once
    and whose queries pass by in batches; a block's k best per query are merged by a ranking that is limited before
    it is dealt.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(parts, n // (BLOCK // 8)))
    data = rows.select("rid", "vec_id", "raw", F.lit(False).alias("asks"), F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("b"))
    asks = rows.where(is_query).select("rid", "vec_id", "raw", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def answers(lists: SortedLists | None, rid: np.ndarray, vec: np.ndarray, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if lists is None:
            return
        queries = np.floor(matrix(asked.column("raw")) * SCALE)
        ask_rid, ask_vec = asked.column("rid").to_numpy(), asked.column("vec_id").to_numpy()
        out: list[list] = [[] for _ in range(5)]
        for i, found in enumerate(lists.candidates(queries, min(k + 1, len(rid)))):  # one more, for the query's own row
            found = found[rid[found] != ask_rid[i]]
            scores = exact_scores(lists.v[found], queries[i])
            best = sorted(range(len(found)), key=lambda j: (-scores[j], vec[found[j]]))[:k]  # noqa: B023
            for j in best:
                short = min(_LONG, max(-_LONG - 1, scores[j]))
                for c, v in zip(out, (int(ask_rid[i]), int(ask_vec[i]), int(vec[found[j]]), short, float(min(10**308, max(-(10**308), scores[j])))), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.float64())], ["query_rid", "query_id", "vec_id", "score", "size"])

    def run(batches):
        """Batches come by block, its rows before its queries."""
        now, held, lists = -1, [], None
        rid = vec = np.zeros(0, dtype=np.int64)
        for batch in batches:
            b, ask = batch.column("b").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = bounds(2 * b + ask)
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                piece = batch.slice(a, z - a)
                if b[a] != now:
                    now, held, lists = int(b[a]), [], None
                if not ask[a]:
                    held.append(piece)
                    continue
                if held:
                    table = pa.Table.from_batches(held)
                    rid, vec = table.column("rid").to_numpy(), table.column("vec_id").to_numpy()
                    lists, held = SortedLists(np.floor(matrix(table.column("raw")) * SCALE)), []
                for at in range(0, z - a, QUERIES):
                    yield from answers(lists, rid, vec, piece.slice(at, QUERIES))

    cells = data.unionByName(asks)
    partial = cells.repartition(max(1, min(blocks, 4 * parts)), "b").sortWithinPartitions("b", "asks").mapInArrow(run, "query_rid long, query_id long, vec_id long, score long, size double")
    order = Window.partitionBy("query_rid").orderBy(F.desc("size"), F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
