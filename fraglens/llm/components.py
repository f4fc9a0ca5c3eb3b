"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglens.llm.common import discard, forest, materialise

#: Edges that a task contracts by itself (16 MB); more are dealt to more tasks.
BLOCK = 1 << 20


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the smallest node around that node."""
    both = _both(edges)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    around = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return around.unionByName(low.select("u", F.col("low").alias("v")))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: each node of a block with the smallest one that the block's edges lead to."""
    held: list[pa.RecordBatch] = []
    n = 0

    def stars(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        low = nodes[forest(at[: len(u)], at[len(u) :], len(nodes))]
        moved = low != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(low[moved])], ["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= 2 * BLOCK:
            yield from stars(held)
            held, n = [], 0
    if held:
        yield from stars(held)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u long, v long): root is the smallest node of its component.

    Nodes without an edge to another node are absent. Rows with a null end or with u = v are ignored.
    Edges are contracted to stars in blocks of about BLOCK first. That is all where one block holds them; otherwise
    rounds of stars over all edges follow until nothing changes. Each round is written to the shared folder, so a lost executor costs one round at most; nothing but a
    count and a checksum reaches the driver. Rounds grow with the logarithm of the longest chain.
    """
    edges = materialise(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
    blocks = 1 + edges.count() // BLOCK
    stars = materialise(edges.repartition(blocks, "u", "v").mapInArrow(_contract, "u long, v long"))
    discard(edges)
    if blocks == 1:
        return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    edges = stars
    before = tuple(edges.agg(*mark).first())
    for _ in range(max_rounds):
        if not before[0]:
            break
        stars = materialise(_small_star(_large_star(edges).where("u <> v").distinct()).where("u <> v").distinct())
        now = tuple(stars.agg(*mark).first())
        discard(edges)
        edges = stars
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
