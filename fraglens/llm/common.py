"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows per Arrow batch: texts may be long, so batches stay small and the workers' memory bounded.
BATCH_ROWS = 1000
BATCH_BYTES = "16m"
#: Whether Spark deletes a write's shuffle files at its end, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers; texts make rows large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch_dir(spark: SparkSession) -> str:
    """A new path below the session's shared checkpoint folder (a local one only where none is set)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="fraglens-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage.

    The shuffle files of this write go at its end; nothing else reads them.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    if path := getattr(df, "_scratch", None):
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def slim(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a Python worker, which serves many tasks, gives the memory that it has freed back to the system."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Tables that hold complete groups, from batches sorted by keys; about `rows` rows each or one group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(n, dtype=bool)
        for k in keys:
            column = table.column(k).to_numpy()
            same &= column == column[-1]
        cut = n - (int(np.argmin(same[::-1])) if not same.all() else n)
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, n = table.to_batches(), table.num_rows
        rows = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def packed(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of many small batches in batches of about `rows` rows or `size` bytes."""
    held: list[pa.RecordBatch] = []
    n = weight = 0
    for b in batches:
        held.append(b)
        n, weight = n + b.num_rows, weight + b.nbytes
        if n >= rows or weight >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, weight = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def fields(columns: list[str], held: str = "row") -> list[Column]:
    """The columns, whatever their names, out of the struct `held`; text stands beside it."""
    return [F.col(f"{held}.`{c}`").alias(c) if c != "text" else F.col("text") for c in columns]


def with_row(framed: DataFrame, rest: str) -> StructType:
    """A schema of the column `row` of framed and the columns that rest declares."""
    return StructType([framed.schema["row"], *StructType.fromDDL(rest)])


def columns_of(df: DataFrame, but: Iterable[str] = ()) -> list[Column]:
    """The columns of df, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns if c not in but]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the undirected edges (a[i], b[i])."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [n]])
