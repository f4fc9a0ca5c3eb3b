"""Reading embedding columns: which rows take part, and their numbers as raw bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglens.llm.common import materialise, tune


def usable(vectors: DataFrame) -> DataFrame:
    """rid, vec_id, raw (the numbers as bytes, see matrix()) of rows with finite components, of the most frequent length.

    Null vectors, those with null or non-finite components, of length 0 or of a rarer length, and rows with a null
    vec_id take no part. rid tells rows apart that repeat.
    """
    tune(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    usual = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("e") == (usual[0].n if usual else 0))

    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches):
        for b in batches:
            e = b.column("e").flatten().to_numpy().astype(kind).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("vec_id"), pa.array([kind[-1:].encode() + v.tobytes() for v in e], pa.binary())], ["rid", "vec_id", "raw"])

    return materialise(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "e").mapInArrow(run, "rid long, vec_id long, raw binary"))


def matrix(column) -> np.ndarray:
    """The rows of a raw column in double precision: a byte for the width of a number, then the numbers."""
    values = column.to_pylist()
    kind = "<f" + (values[0][:1].decode() if values else "8")
    return np.frombuffer(b"".join(v[1:] for v in values), dtype=kind).reshape(len(values), -1).astype(np.float64)
