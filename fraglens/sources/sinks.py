"""Writers: fragment files, bedGraph, Parquet bundles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_format(suffix: str) -> tuple[str, str | None]:
    """(format, compression) of an output suffix."""
    name = suffix.lower()
    compression = "gzip" if name.endswith(".gz") else "zstd" if name.endswith(".zst") else None
    stem = re.sub(r"\.(gz|zst)$", "", name).rsplit(".", 1)[-1]
    kind = "bigwig" if stem in ("bw", "bigwig") else "bedgraph" if stem in ("bedgraph", "bg", "bdg") else stem
    return kind, compression


def safe_name(group: str) -> str:
    return group.replace("/", "+").replace(" ", "_")


def _write(df: DataFrame, path: str, columns: list[str], by: str | None, compression: str | None) -> None:
    text = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns)).alias("value")
    if by is None:
        df.select(text).write.mode("overwrite").option("compression", compression or "none").text(path)
        return
    out = df.select(F.translate(F.col(by), "/ ", "+_").alias(by), text)
    out.write.mode("overwrite").partitionBy(by).option("compression", compression or "none").text(path)


def export_fragments(frags: DataFrame, groups: DataFrame, path: str, selections: list[str] | None = None, least: int | None = None, most: int | None = None, compression: str | None = "gzip") -> None:
    """A folder per group of BED rows (chrom, start, end, barcode, count and strand if stranded), in genome order within files."""
    from fraglens.operators.fragments import size_filter

    rows = size_filter(frags, least, most).join(groups, "barcode")
    if selections is not None:
        rows = rows.where(F.col("group").isin(*selections))
    rows = rows.sortWithinPartitions("group", "chrom", "start", "end")
    stranded = not frags.where("strand is not null").isEmpty()
    _write(rows, path, ["chrom", "start", "end", "barcode", "count"] + ["strand"] * stranded, "group", compression)


def write_fragments(frags: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """A fragment file; empty fragments are dropped."""
    _write(frags.where("end > start").sort("barcode", "chrom", "start"), path, ["chrom", "start", "end", "barcode", "count"], None, compression)


def export_coverage(frags: DataFrame, groups: DataFrame, chroms: DataFrame, path: str, width: int = 10, normalization: str | None = "RPKM", smooth_base: int | None = None, compression: str | None = "gzip", **options) -> None:
    """A folder per group of bedGraph rows."""
    from fraglens.operators.intervals import smooth
    from fraglens.operators.matrix import normalised_coverage

    runs = normalised_coverage(frags.join(groups, "barcode"), width, normalization, chroms, by=["group"], **options)
    if smooth_base:
        runs = smooth(runs, smooth_base, ["group"])
    _write(runs.sortWithinPartitions("group", "chrom", "start"), path, ["chrom", "start", "end", "value"], "group", compression)


def write_bundle(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """A folder with one Parquet table per name (obs, var, X, ...)."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{path}/{name}.parquet")


def export_tags(frags: DataFrame, groups: DataFrame, path: str, replicates: DataFrame | None = None, most: int | None = None, selections: list[str] | None = None, compression: str | None = "gzip") -> None:
    """A folder per group, and replicate (barcode, replicate) if there are any, of the fragments that peaks are called from."""
    named = groups if selections is None else groups.where(F.col("group").isin(*selections))
    if replicates is not None:
        named = named.join(replicates, "barcode").select("barcode", F.concat_ws("_", "group", F.col("replicate").cast("string")).alias("group"))
    export_fragments(frags, named, path, most=most, compression=compression)
