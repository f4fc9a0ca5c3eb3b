"""Schemas of the tables, chromosome sizes, and region strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAGMENT = "chrom string, start long, end long, barcode string, count int, strand string"
CONTACT = "barcode string, chrom1 string, start1 long, chrom2 string, start2 long, count int"
BASE_VALUE = "barcode string, chrom string, pos long, methyl int, total int"
REGION = "chrom string, start long, end long, region_id long"
TRANSCRIPT = "tx_name string, tx_id string, gene string, gene_id string, is_coding boolean, chrom string, left long, right long, strand string"

# Sizes of the primary chromosomes of four assemblies.
CHROM_SIZES = {
    "GRCh38": {"chr1": 248956422, "chr2": 242193529, "chr3": 198295559, "chr4": 190214555, "chr5": 181538259, "chr6": 170805979, "chr7": 159345973, "chr8": 145138636, "chr9": 138394717, "chr10": 133797422, "chr11": 135086622, "chr12": 133275309, "chr13": 114364328, "chr14": 107043718, "chr15": 101991189, "chr16": 90338345, "chr17": 83257441, "chr18": 80373285, "chr19": 58617616, "chr20": 64444167, "chr21": 46709983, "chr22": 50818468, "chrX": 156040895, "chrY": 57227415},
    "GRCm38": {"chr1": 195471971, "chr2": 182113224, "chr3": 160039680, "chr4": 156508116, "chr5": 151834684, "chr6": 149736546, "chr7": 145441459, "chr8": 129401213, "chr9": 124595110, "chr10": 130694993, "chr11": 122082543, "chr12": 120129022, "chr13": 120421639, "chr14": 124902244, "chr15": 104043685, "chr16": 98207768, "chr17": 94987271, "chr18": 90702639, "chr19": 61431566, "chrX": 171031299, "chrY": 91744698},
}


def chrom_table(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """(ord, chrom, length) in the order of the dict."""
    return spark.createDataFrame([(i, c, int(n)) for i, (c, n) in enumerate(sizes.items())], "ord int, chrom string, length long")


def genome_index(chroms: DataFrame, step: int = 1) -> DataFrame:
    """(ord, chrom, length, n_bins, offset): bins of `step` bases laid end to end; the last of each may be shorter."""
    bins = F.ceil(F.col("length") / step).cast("long")
    before = F.sum("n_bins").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return chroms.withColumn("n_bins", bins).withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


def with_bin(df: DataFrame, index: DataFrame, step: int, pos: str = "pos") -> DataFrame:
    """Adds the linear bin of (chrom, pos); positions on unknown chromosomes or beyond the end are dropped."""
    known = F.broadcast(index.select("chrom", F.col("length").alias("_length"), F.col("offset").alias("_offset")))
    at = F.col(pos)
    return df.join(known, "chrom").where((at >= 0) & (at < F.col("_length"))).withColumn("bin", (F.col("_offset") + F.floor(at / step)).cast("long")).drop("_length", "_offset")


def bin_regions(bins: DataFrame, index: DataFrame, step: int) -> DataFrame:
    """Adds chrom, start, end of linear bins; a chromosome's last bin ends with it."""
    i = F.broadcast(index.select("chrom", F.col("length").alias("_length"), F.col("offset").alias("_offset"), F.col("n_bins").alias("_n")))
    start = (F.col("bin") - F.col("_offset")) * step
    inside = (F.col("bin") >= F.col("_offset")) & (F.col("bin") < F.col("_offset") + F.col("_n"))
    return bins.join(i, inside).withColumn("start", start).withColumn("end", F.least(start + step, F.col("_length"))).drop("_length", "_offset", "_n")


def region_string(chrom: Column | str = "chrom", start: Column | str = "start", end: Column | str = "end") -> Column:
    c = [F.col(x) if isinstance(x, str) else x for x in (chrom, start, end)]
    return F.format_string("%s:%d-%d", *c)


def parse_region(text: Column) -> Column:
    """struct(chrom, start, end) of chrom:start-end; null where the text isn't one."""
    part = [F.regexp_extract(text, r"^(.+):([0-9,]+)-([0-9,]+)$", i) for i in (1, 2, 3)]
    number = [F.regexp_replace(p, ",", "").cast("long") for p in part[1:]]
    return F.when(part[0] != "", F.struct(part[0].alias("chrom"), number[0].alias("start"), number[1].alias("end")))
