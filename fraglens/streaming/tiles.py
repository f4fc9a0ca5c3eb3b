"""Tile counts that are kept up to date while fragment files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraglens.operators.matrix import tile_matrix
from fraglens.schemas import FRAGMENT


def fragment_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Fragment files as they appear in a folder."""
    raw = spark.readStream.schema(FRAGMENT).option("sep", "\t").option("comment", "#").option("maxFilesPerTrigger", files_per_trigger).csv(path)
    return raw.withColumn("count", F.coalesce("count", F.lit(1)))


def tile_counts(frags: DataFrame, chroms: DataFrame, width: int = 500, strategy: str = "paired-insertion") -> DataFrame:
    """The tile matrix of a stream: its state is one row per cell and tile. Write in update mode."""
    return tile_matrix(frags, chroms, width, strategy)
