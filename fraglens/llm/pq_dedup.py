"""Near-duplicate embeddings by product quantisation.

Unit vectors are listed by their nearest coarse centroid, and what remains is coded by a small codebook for each
subspace. A vector visits the lists in which a neighbour may be: by the plane between two centroids, a neighbour
within a distance r can only be listed elsewhere if the plane is no further away than r. Few neighbours lie straight
across a plane, so a share of r, the reach, finds nearly all; it is calibrated on the sample, and with a recall of 1 it
is r itself, which leaves out nothing. In a list, distances come from table lookups on the codes; with each code's own
error they bound the true distance, so that no neighbour is passed over. What is left is judged by the exact cosine.
Since both of a pair visit each other's list, only visits to later lists are made, and lists are dealt in groups: a
vector is sent once to a group in which it visits any list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglens.llm.common import bounds, forest, materialise, whole_groups
from fraglens.llm.components import connected_components
from fraglens.llm.vectors import matrix, usable

#: Rows that the index is fitted on (those with the smallest hashes), lists, subspaces and codes.
SAMPLE, MOST_LISTS, SUBSPACES, CODES = 32768, 4096, 16, 256
#: Members and visitors of a group of lists that meet at once.
BLOCK = 8192
#: Sampled vectors, and neighbours made up for each, from which the reach is calibrated, and what is added to it.
ASKERS, MADE, MARGIN = 2048, 4, 0.02
#: Links of 256 sampled vectors that take part in that, by chance if there are more.
PAIRS = 8192
#: Distances that are looked up at once.
LOOKUPS = 1 << 20


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very small or large numbers leave the range
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids of x, from random rows; an empty one keeps its place."""
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


class Index:
    """Coarse centroids and residual codebooks, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float, recall: float):
        radius = float(np.sqrt(2 - 2 * cosine))
        rng = np.random.default_rng(7)
        self.radius = radius
        self.coarse = kmeans(sample, lists, 8, rng)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(rest[:, d], CODES, 6, rng) for d in self.cuts]
        gap = self.coarse[:, None, :] - self.coarse[None, :, :] if len(self.coarse) <= 512 else None
        self.between = np.linalg.norm(gap, axis=2) if gap is not None else np.sqrt(np.maximum(0, (d := (self.coarse**2).sum(axis=1))[:, None] + d - 2 * self.coarse @ self.coarse.T))

        self.reach = 1.0 if recall >= 1 else self._calibrated(sample, cosine, recall, rng)

    def _calibrated(self, sample: np.ndarray, cosine: float, recall: float, rng: np.random.Generator) -> float:
        """The share of the radius that finds this share of links: those of the sample, and made-up ones.

        A made-up neighbour is as far away as a link allows, towards another vector of the sample, so that it lies where
        the data lie, whatever their dimension.
        """
        some = sample[rng.permutation(len(sample))[:ASKERS]]
        left, right = [], []
        for a in range(0, len(some), 256):
            i, j = np.nonzero(some[a : a + 256] @ sample.T >= cosine)
            if len(i) > PAIRS:  # the sample may hold large groups
                pick = rng.choice(len(i), PAIRS, replace=False)
                i, j = i[pick], j[pick]
            left.append(some[a + i])
            right.append(sample[j])
        real = self._needed(np.concatenate(left), np.concatenate(right))
        u = np.repeat(some, MADE, axis=0)
        to = sample[rng.integers(len(sample), size=len(u))]
        to = to - (to * u).sum(axis=1, keepdims=True) * u
        size = np.linalg.norm(to, axis=1)
        ok = size > 1e-9
        made = self._needed(u[ok], cosine * u[ok] + np.sqrt(1 - cosine**2) * to[ok] / size[ok, None])
        return min(1.0, MARGIN + max((float(np.quantile(x, recall, method="higher")) for x in (real, made) if len(x)), default=1.0))

    def _needed(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The reach at which the vector of a pair with the earlier list visits the other's, of pairs in different lists."""
        a, b = nearest(u, self.coarse), nearest(v, self.coarse)
        apart = a != b
        a, b = a[apart], b[apart]
        x = np.where((a < b)[:, None], u[apart], v[apart])
        low, high = self.coarse[np.minimum(a, b)], self.coarse[np.maximum(a, b)]
        return (((x - high) ** 2).sum(axis=1) - ((x - low) ** 2).sum(axis=1)) / np.maximum(2 * self.radius * self.between[a, b], 1e-12)

    def encode(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error) of unit vectors."""
        home = nearest(u, self.coarse)
        rest = u - self.coarse[home]
        codes = np.stack([nearest(rest[:, d], b) for d, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        near = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return home, codes, np.linalg.norm(rest - near, axis=1)

    def probes(self, u: np.ndarray, home: np.ndarray) -> np.ndarray:
        """For each vector and list, whether a neighbour may be listed there."""
        d2 = (self.coarse**2).sum(axis=1) - 2 * u @ self.coarse.T
        own = d2[np.arange(len(u)), home]
        return d2 - own[:, None] <= 2 * (self.reach * self.radius + 1e-6) * self.between[home]

    def within(self, u: np.ndarray, at: int, codes: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(member, vector) pairs of the coded members of a list and vectors, by the distances that tables give; most: one for each member."""
        rest = (u - self.coarse[at]).astype(np.float32)
        total = np.zeros((len(codes), len(u)), dtype=np.float32)
        for m, (d, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            b = b.astype(np.float32)
            table = (b * b).sum(axis=1)[:, None] + (rest[:, d] ** 2).sum(axis=1) - 2 * b @ rest[:, d].T
            total += table[codes[:, m]]
        return np.nonzero(total <= (most**2)[:, None].astype(np.float32))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    Rows link when the cosine of their vectors, in double precision, is at least `cosine`. n_links counts the other
    rows linked directly, component_id is the smallest vec_id reachable (itself included), kept says whether that is
    the row's own. Null or zero vectors, those with null or non-finite components or of a rare length link with
    nothing. Rows that share a vec_id are one node of the components. Equal vectors are compared once and counted.
    The index is fitted on at most SAMPLE rows and holds every row. Of the links between vectors in different lists it
    finds about the share `recall` or more, and all others; with recall 1 it finds all, at more visits. An empty table
    gives an empty result; other columns play no part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)

    def nonzero(batches):
        for b in batches:
            yield b.filter(pa.array((matrix(b.column("raw")) != 0).any(axis=1)))

    rows = materialise(rows.mapInArrow(nonzero, rows.schema))
    classes = materialise(rows.groupBy("raw").agg(F.min("rid").alias("cid"), F.min("vec_id").alias("node"), F.count("*").alias("n")))
    total = classes.count()
    sample = classes.select("raw").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toArrow().column("raw") if total else None
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not total:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lists = int(min(MOST_LISTS, max(1, round(total**0.5))))
    span = -(-lists // -(-total // BLOCK))  # lists in a group
    shared = spark.sparkContext.broadcast(Index(_unit(matrix(sample)), lists, cosine, recall))

    def encode(batches):
        index = shared.value
        for b in batches:
            u = _unit(matrix(b.column("raw")))
            home, codes, error = index.encode(u)
            group = home // span
            go = index.probes(u, home) & (np.arange(len(index.coarse)) >= home[:, None])
            go = np.logical_or.reduceat(go, np.arange(0, len(index.coarse), span), axis=1)
            visits = [np.flatnonzero(p).astype(np.int32) for p in go]
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("node"), b.column("n"), b.column("raw"), pa.array(group.astype(np.int32)), pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(visits, pa.list_(pa.int32()))], ["cid", "node", "n", "raw", "group", "home", "codes", "error", "visits"])

    coded = materialise(classes.select("cid", "node", "n", "raw").mapInArrow(encode, "cid long, node long, n long, raw binary, group int, home int, codes binary, error double, visits array<int>"))
    members = coded.groupBy(F.col("group").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mbs"))
    visitors = coded.select(F.explode("visits").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("vbs"))
    size = F.broadcast(members.join(visitors, "list"))  # at most MOST_LISTS rows: groups of lists
    blocks = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    column = ["list", "mb", "vb", "visits_here", "cid", "node", "n", "raw", "home", "codes", "error"]
    listed = coded.withColumn("list", F.col("group")).join(size, "list").withColumns({"mb": blocks("mbs"), "visits_here": F.lit(False)}).withColumn("vb", all_of("vbs")).select(column)
    visiting = coded.withColumn("list", F.explode("visits")).join(size, "list").withColumns({"vb": blocks("vbs"), "visits_here": F.lit(True), "codes": F.lit(b"")}).withColumn("mb", all_of("mbs")).select(column)

    def meet(batches):
        index = shared.value
        for table in whole_groups(batches, ["list", "mb", "vb"], rows=BLOCK):
            x = {c: table.column(c).to_numpy() for c in ("list", "mb", "vb", "visits_here", "cid", "node", "n", "home", "error")}
            u = _unit(matrix(table.column("raw")))
            codes = table.column("codes")
            change = (x["list"][1:] != x["list"][:-1]) | (x["mb"][1:] != x["mb"][:-1]) | (x["vb"][1:] != x["vb"][:-1])
            cuts = bounds(np.cumsum(np.concatenate([[0], change])))
            counts = np.zeros(len(u), dtype=np.int64)
            left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                at = np.arange(a, z)
                inside, guests = at[~x["visits_here"][a:z]], at[x["visits_here"][a:z]]
                if not len(inside) or not len(guests):
                    continue
                go = index.probes(u[guests], x["home"][guests])
                for c in np.unique(x["home"][inside]).tolist():
                    here, there = inside[x["home"][inside] == c], guests[go[:, c] & (x["home"][guests] <= c)]
                    own = np.frombuffer(b"".join(codes.take(pa.array(here)).to_pylist()), dtype=np.uint8).reshape(len(here), -1)
                    step = max(1, LOOKUPS // len(here))
                    for k in range(0, len(there), step):
                        some = there[k : k + step]
                        j, i = index.within(u[some], c, own, index.radius + x["error"][here] + 1e-3)
                        g, m = some[i], here[j]
                        # each pair is met once: in the later list, or by the smaller one's visit to their own
                        once = (x["home"][g] < c) | (x["cid"][g] < x["cid"][m])
                        g, m = g[once], m[once]
                        close = np.einsum("ij,ij->i", u[g], u[m]) >= cosine
                        g, m = g[close], m[close]
                        np.add.at(counts, g, x["n"][m])
                        np.add.at(counts, m, x["n"][g])
                        left.append(g)
                        right.append(m)
            root = forest(np.concatenate(left), np.concatenate(right), len(u))
            keep = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(x["cid"][keep]), pa.array(counts[keep]), pa.array(x["node"][keep]), pa.array(x["node"][root[keep]])], ["cid", "links", "u", "v"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = materialise(listed.unionByName(visiting).repartition(n, "list", "mb", "vb").sortWithinPartitions("list", "mb", "vb").mapInArrow(meet, "cid long, links long, u long, v long"))
    same = rows.join(classes.select("raw", F.col("node").alias("v"), F.col("cid"), F.col("n")), "raw").select("rid", "vec_id", "v", "cid", "n")
    same = materialise(same)
    roots = connected_components(met.select("u", "v").unionByName(same.select(F.col("vec_id").alias("u"), "v")))
    linked = same.join(met.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    # rows that took no part, repeated rows included
    rest = every.groupBy("vec_id").count().join(linked.groupBy("vec_id").agg(F.count("*").alias("had")), "vec_id", "left")
    idle = rest.select("vec_id", F.explode(F.when(F.col("count") > F.coalesce("had", F.lit(0)), F.sequence(F.lit(1).cast("long"), F.col("count") - F.coalesce("had", F.lit(0)))).otherwise(F.array().cast("array<long>"))).alias("k")).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = linked.unionByName(idle).join(roots, F.col("vec_id") == F.col("node"), "left")
    return out.select("vec_id", "n_links", F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.coalesce("root", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
