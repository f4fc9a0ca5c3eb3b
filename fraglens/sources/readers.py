"""Readers of text formats into DataFrames; compression goes by the extension (.gz, .zst)."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraglens.operators.motif import Motif


def _tsv(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path, sep="\t", comment="#", mode="PERMISSIVE", quote="")


def read_fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, start, end, barcode (null for '.'), count (1 if absent) and strand (null if absent) of a fragment file."""
    raw = _tsv(spark, path, ["chrom", "start", "end", "barcode", "count", "strand"])
    known = lambda c: F.nullif(F.col(c), F.lit("."))
    return raw.select("chrom", F.col("start").cast("long"), F.col("end").cast("long"), known("barcode").alias("barcode"), F.coalesce(known("count").cast("int"), F.lit(1)).alias("count"), known("strand").alias("strand"))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    raw = _tsv(spark, path, ["barcode", "chrom1", "start1", "chrom2", "start2", "count"])
    return raw.select("barcode", "chrom1", F.col("start1").cast("long"), "chrom2", F.col("start2").cast("long"), F.coalesce(F.col("count").cast("int"), F.lit(1)).alias("count"))


def read_values(spark: SparkSession, directory: str) -> DataFrame:
    """barcode, chrom, pos, methyl, total from one file per cell (its stem is the barcode); headers are skipped."""
    raw = spark.read.text(directory).select("value", F.col("_metadata.file_name").alias("f"))
    part = F.split(F.trim("value"), r"\s+")
    stem = F.regexp_replace(F.regexp_replace("f", r"\.(gz|zst|bz2)$", ""), r"\.[^.]*$", "")
    number = lambda i: F.get(part, F.lit(i)).try_cast("int")
    rows = raw.select(stem.alias("barcode"), part[0].alias("chrom"), F.get(part, F.lit(1)).try_cast("long").alias("pos"), number(2).alias("methyl"), number(3).alias("_u"))
    return rows.where("pos is not null and methyl is not null and _u is not null").select("barcode", "chrom", "pos", "methyl", (F.col("methyl") + F.col("_u")).alias("total"))


def read_gtf(spark: SparkSession, path: str, gff: bool = False) -> DataFrame:
    """Transcripts of an annotation: tx_name, tx_id, gene, gene_id, is_coding, chrom, left, right (1-based), strand."""
    raw = _tsv(spark, path, ["chrom", "src", "kind", "left", "right", "score", "strand", "frame", "attributes"]).where("kind = 'transcript'")
    if gff:
        at = lambda k: F.nullif(F.regexp_extract("attributes", rf"(?:^|;)\s*{k}=([^;]*)", 1), F.lit(""))
    else:
        at = lambda k: F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{k} "([^"]*)"', 1), F.lit(""))
    kind = at("transcript_type")
    return raw.select(at("transcript_name").alias("tx_name"), at("transcript_id").alias("tx_id"), at("gene_name").alias("gene"), at("gene_id").alias("gene_id"), F.when(kind.isNotNull(), kind == "protein_coding").alias("is_coding"), "chrom", F.col("left").cast("long"), F.col("right").cast("long"), "strand")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """By extension (before .gz): gff and gff3 or gtf; else whichever form the attributes have."""
    name = path.removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if name in ("gff", "gff3", "gtf"):
        return read_gtf(spark, path, name != "gtf")
    found = read_gtf(spark, path, True)
    return found if not found.where("tx_id is not null").isEmpty() else read_gtf(spark, path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    raw = _tsv(spark, path, ["chrom", "start", "end"])
    return raw.select("chrom", F.col("start").cast("long"), F.col("end").cast("long"))


def read_whitelist(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """(barcode) from a file with one per line, or from a list."""
    if isinstance(source, str):
        return spark.read.text(source).select(F.trim("value").alias("barcode")).where("barcode <> ''").distinct()
    return spark.createDataFrame([(b,) for b in source], "barcode string").distinct()


def read_regions(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """(region) strings from a file or a list of chrom:start-end."""
    if isinstance(source, str):
        return spark.read.text(source).select(F.trim("value").alias("region")).where("region <> ''")
    return spark.createDataFrame([(r,) for r in source], "region string")


def parse_meme(text: str) -> list[Motif]:
    """Motifs of a minimal MEME file; `w=` gives the number of rows."""
    out: list[Motif] = []
    lines = iter(text.splitlines())
    head: list[str] = []
    for line in lines:
        if line.startswith("MOTIF"):
            head = line.split()[1:]
        elif "w=" in line and head:
            width = int(line.split("w=")[1].split()[0])
            rows = [tuple(float(v) for v in next(lines).split()[:4]) for _ in range(width)]
            out.append(Motif(head[0], tuple(rows), head[1] if len(head) > 1 else None))
            head = []
    return out


def read_meme(spark: SparkSession, path: str) -> list[Motif]:
    return [m for r in spark.read.text(path, wholetext=True).collect() for m in parse_meme(r.value)]


def best_by_name(motifs: list[Motif]) -> list[Motif]:
    """The motif with the most information of each name; the first of equals."""
    best: dict[str, Motif] = {}
    for m in motifs:
        name = (m.name or m.id).split("+")[0]
        if name not in best or m.information() > best[name].information():
            best[name] = m
    return list(best.values())


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """(chrom, chunk, seq): sequences in chunks of equal length, so that a region touches few of them.

    Records are split by '>' on the executors; a chromosome is one value while it is cut.
    """
    raw = spark.read.option("lineSep", ">").text(path).where("value <> ''")
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")
    named = raw.select(F.regexp_extract("value", r"^(\S+)", 1).alias("chrom"), seq.alias("s"))
    at = F.posexplode(F.sequence(F.lit(1), F.greatest(F.length("s"), F.lit(1)), F.lit(chunk))).alias("chunk", "a")
    return named.select("chrom", "s", at).select("chrom", "chunk", F.substr("s", F.col("a"), F.lit(chunk)).alias("seq"))


def fetch(regions: DataFrame, sequences: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """regions (region_id, chrom, start, end) with seq; those that reach beyond their chromosome have none."""
    touched = regions.select("region_id", "chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / chunk).cast("int"), F.floor((F.col("end") - 1) / chunk).cast("int"))).alias("chunk"))
    lo = F.greatest(F.col("start") - F.col("chunk") * chunk, F.lit(0))
    hi = F.least(F.col("end") - F.col("chunk") * chunk, F.lit(chunk))
    part = touched.join(sequences, ["chrom", "chunk"]).select("region_id", "start", "end", F.struct("chunk", F.substr("seq", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("s")).alias("p"))
    whole = part.groupBy("region_id", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.s), "").alias("seq"))
    return regions.join(whole.where(F.length("seq") == F.col("end") - F.col("start")).select("region_id", "seq"), "region_id", "left")


def read_10x_mtx(spark: SparkSession, directory: str, prefix: str = "") -> DataFrame:
    """(barcode, feature, value) of a MatrixMarket directory (features by cells)."""

    def find(*names: str) -> str:
        return next((p for n in names for p in (f"{directory}/{prefix}{n}", f"{directory}/{prefix}{n}.gz") if os.path.exists(p)), f"{directory}/{prefix}{names[0]}.gz")

    def numbered(path: str, name: str) -> DataFrame:
        lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("n", "line"))
        return lines.select((F.col("n") + 1).cast("long").alias(f"_{name}"), F.split("line", "\t")[0].alias(name))

    part = F.split("value", r"\s+")
    body = spark.read.text(find("matrix.mtx")).where(~F.col("value").startswith("%")).select(part[0].cast("long").alias("_feature"), part[1].cast("long").alias("_barcode"), part[2].cast("double").alias("value"))
    names = numbered(find("features.tsv", "genes.tsv"), "feature"), numbered(find("barcodes.tsv"), "barcode")
    # the first line has the sizes; its row and column are the last of each, its value is the number of the others
    size = body.agg(F.max("_feature").alias("_f"), F.max("_barcode").alias("_b"), F.count("*").alias("_n"))
    entries = body.join(F.broadcast(size)).where(~((F.col("_feature") == F.col("_f")) & (F.col("_barcode") == F.col("_b")) & (F.col("value") == F.col("_n") - 1)) | F.lit(False))
    return entries.join(names[0], "_feature").join(names[1], "_barcode").select("barcode", "feature", "value")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a Parquet bundle by name."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = sorted(f.getPath().getName() for f in found)
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{path}/{n}") for n in names if n.endswith(".parquet")}


def concat(samples: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables with a sample column."""
    out = None
    for name, df in samples.items():
        part = df.withColumn("sample", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
