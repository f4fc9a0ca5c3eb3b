"""Sequencing alignments (name, flag, mapq, chrom, pos, cigar, quality) to fragments, and library counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the flag field.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, LAST, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 8, 16, 64, 128, 256, 512, 1024, 2048
EXCLUDED = UNMAPPED | MATE_UNMAPPED | SECONDARY | FAILED | DUPLICATE


def bit(mask: int) -> Column:
    return F.col("flag").bitwiseAND(mask) != 0


def with_barcode(reads: DataFrame, regex: str, column: str = "name", name: str = "barcode") -> DataFrame:
    """Adds the first group of regex; null where it doesn't match, an empty match stays empty."""
    return reads.withColumn(name, F.when(F.regexp_like(column, F.lit(regex)), F.regexp_extract(column, regex, 1)))


def usable(reads: DataFrame, paired: bool = True, min_mapq: int | None = 30) -> DataFrame:
    """Primary, mapped reads with a barcode, properly paired, of enough quality (a missing one is 255)."""
    ok = ~bit(EXCLUDED) & ~bit(SUPPLEMENTARY) & F.col("barcode").isNotNull()
    if paired:
        ok = ok & bit(PROPER)
    if min_mapq is not None:
        ok = ok & (F.coalesce("mapq", F.lit(255)) >= min_mapq)
    return reads.where(ok)


def _clipped(pattern: str) -> Column:
    parts = F.regexp_extract_all(F.regexp_extract("cigar", pattern, 0), F.lit(r"(\d+)[SH]"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def with_ends(reads: DataFrame) -> DataFrame:
    """Adds span, unclipped_start and unclipped_end (0-based, end exclusive) and five_prime."""
    spans = F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    out = reads.withColumn("span", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")))
    out = out.withColumns({"unclipped_start": F.col("pos") - _clipped(r"^(\d+[SH])+"), "unclipped_end": F.col("pos") + F.col("span") + _clipped(r"(\d+[SH])+$")})
    return out.withColumn("five_prime", F.when(bit(REVERSE), F.col("unclipped_end") - 1).otherwise(F.col("unclipped_start")))


def fragments_single(reads: DataFrame) -> DataFrame:
    """One fragment for each barcode, chromosome, strand and 5' end, with the number of reads; the best read's extent."""
    r = with_ends(reads).withColumn("strand", F.when(bit(REVERSE), "-").otherwise("+"))
    best = F.max_by(F.struct("pos", F.col("pos") + F.col("span")), F.struct("quality", "name"))
    return r.groupBy("barcode", "chrom", "strand", "five_prime").agg(best.alias("b"), F.count("*").cast("int").alias("count")).select("chrom", F.col("b.pos").alias("start"), F.col("b.col2").alias("end"), "barcode", "count", "strand")


def fragments_paired(reads: DataFrame) -> DataFrame:
    """One fragment for each barcode and pair of 5' ends and strands, with the number of pairs; lone reads are dropped.

    The best first and the best last read are chosen on their own.
    """
    r = with_ends(reads)
    side = F.struct("chrom", "five_prime", bit(REVERSE).alias("reverse"), "unclipped_start", "unclipped_end", "quality", "pos", "span")
    pairs = r.groupBy("barcode", "name").agg(F.max(F.when(bit(FIRST), side)).alias("a"), F.max(F.when(bit(LAST), side)).alias("b")).where("a is not null and b is not null and a.chrom = b.chrom")
    swap = F.col("a.five_prime") > F.col("b.five_prime")
    key = [F.when(swap, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(f"l_{c}") for c in ("chrom", "five_prime", "reverse")] + [F.when(swap, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(f"r_{c}") for c in ("five_prime", "reverse")]
    keyed = pairs.select("barcode", "name", "a", "b", *key)
    groups = keyed.groupBy("barcode", "l_chrom", "l_five_prime", "l_reverse", "r_five_prime", "r_reverse").agg(F.max_by("a", F.struct("a.quality", "name")).alias("a"), F.max_by("b", F.struct("b.quality", "name")).alias("b"), F.count("*").cast("int").alias("count"))
    return groups.select(F.col("l_chrom").alias("chrom"), F.least("a.unclipped_start", "b.unclipped_start").alias("start"), F.greatest("a.unclipped_end", "b.unclipped_end").alias("end"), "barcode", "count", F.lit(None).cast("string").alias("strand"))


def flagstat(reads: DataFrame) -> DataFrame:
    """One row of counters by flag, in the usual nesting."""
    n = lambda c: F.count(F.when(c, 1))
    primary = ~bit(SECONDARY) & ~bit(SUPPLEMENTARY)
    pair = primary & bit(PAIRED)
    both = pair & ~bit(UNMAPPED) & ~bit(MATE_UNMAPPED)
    return reads.agg(
        F.count("*").alias("read"), n(bit(SECONDARY)).alias("secondary"), n(~bit(SECONDARY) & bit(SUPPLEMENTARY)).alias("supplementary"), n(primary).alias("primary_reads"),
        n(~bit(UNMAPPED)).alias("mapped"), n(primary & ~bit(UNMAPPED)).alias("primary_mapped"), n(bit(DUPLICATE)).alias("duplicate"), n(primary & bit(DUPLICATE)).alias("primary_duplicate"),
        n(pair).alias("paired"), n(pair & bit(FIRST)).alias("read_1"), n(pair & bit(LAST)).alias("read_2"), n(both & bit(PROPER)).alias("proper_pair"), n(both).alias("mate_mapped"), n(pair & ~bit(UNMAPPED) & bit(MATE_UNMAPPED)).alias("singleton"),
    )


def library_qc(reads: DataFrame, mito: tuple[str, ...] = ("chrM", "M"), min_mapq: int = 30) -> DataFrame:
    """One row: shares of primary reads that are unmapped, confidently mapped, have a barcode, and lie off the nucleus."""
    p = reads.where(~bit(SECONDARY) & ~bit(SUPPLEMENTARY))
    share = lambda c: F.try_divide(F.count(F.when(c, 1)).cast("double"), F.count("*").cast("double"))
    sure = ~bit(UNMAPPED) & (F.coalesce("mapq", F.lit(255)) >= min_mapq)
    return p.agg(F.count("*").alias("sequenced_reads"), share(bit(UNMAPPED)).alias("frac_unmapped"), share(sure).alias("frac_confident"), share(F.col("barcode").isNotNull()).alias("frac_valid_barcode"), share(sure & F.col("chrom").isin(*mito)).alias("frac_nonnuclear"))
