"""Joins and sweeps over half-open genomic intervals (chrom, start, end).

Overlap is an equi-join on (chrom, bin): both sides are dealt to the bins that they touch, and a pair is kept in the
bin where its overlap begins, so that no pair is met twice and no distinct() is needed. No plan here has a cartesian
product, and a side is only broadcast where the caller or the optimiser knows its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BIN = 1000


def bins_of(start: Column, end: Column, width: int) -> Column:
    """Bins that [start, end) touches."""
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def overlap_join(left: DataFrame, right: DataFrame, width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of overlapping rows (inner), or the left rows with (left_semi) or without (left_anti) a partner.

    The columns of right come as r_<name>; those of left keep theirs. For the semi and anti forms duplicates in left
    stay: a row is asked, not its value.
    """
    if how == "left_semi":
        return overlapping(left, right, width)
    if how == "left_anti":
        return _apart(left, right, width)
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    a = left.withColumn("_bin", F.explode(bins_of(F.col("start"), F.col("end"), width)))
    b = r.withColumn("_bin", F.explode(bins_of(F.col("r_start"), F.col("r_end"), width)))
    met = a.join(b, (a["chrom"] == b["r_chrom"]) & (a["_bin"] == b["_bin"]) & (a["start"] < b["r_end"]) & (b["r_start"] < a["end"]))
    first = F.floor(F.greatest(a["start"], b["r_start"]) / width)
    return met.where(first == a["_bin"]).drop("_bin")


def overlapping(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """The rows of left that overlap any row of right, each once and as often as it is there.

    right is merged into islands; a row is kept where it meets the first island that it overlaps, so that nothing is grouped.
    """
    order = Window.partitionBy("chrom").orderBy("start")
    marked = islands_merged(right).withColumn("prev", F.lag("end").over(order))
    met = overlap_join(left, marked, width).where(F.col("r_prev").isNull() | (F.col("r_prev") <= F.col("start")))
    return met.select(*left.columns)


def _apart(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """The rows of left that overlap no row of right: those in one or two bins by anti joins on either, longer ones by their flag."""
    merged = islands_merged(right)
    b = merged.select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.explode(bins_of(F.col("start"), F.col("end"), width)).alias("r_bin"))
    first, last = F.floor(F.col("start") / width), F.floor((F.greatest("end", F.col("start") + 1) - 1) / width)
    short = F.coalesce(last - first < 2, F.lit(True))
    out = left.where(short)
    for spot in (first, last):
        out = out.withColumn("_bin", spot)
        out = out.join(b, (out["chrom"] == b["r_chrom"]) & (out["_bin"] == b["r_bin"]) & (out["start"] < b["r_end"]) & (b["r_start"] < out["end"]), "left_anti").drop("_bin")
    return out.unionByName(overlap_flag(left.where(~short), right, width, "_hit").where("not _hit").drop("_hit"))


def overlap_flag(left: DataFrame, right: DataFrame, width: int = BIN, name: str = "hit") -> DataFrame:
    """left with a boolean that says whether each row overlaps any row of right.

    right is merged into islands first: a row then meets each base once, and a row of left that lies in one bin meets
    a bounded number of islands. The flag is grouped by a row key that is a function of the row, not of its place.
    """
    columns = left.columns
    counted = left.groupBy(*columns).agg(F.count("*").alias("_n"))
    hits = overlapping(counted.select(*columns), right, width)
    hits = hits.select(*(F.col(c).alias(f"_h_{c}") for c in columns), F.lit(True).alias("_hit"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in columns))
    flagged = counted.join(hits, same, "left").select(*columns, "_n", F.coalesce("_hit", F.lit(False)).alias(name))
    return flagged.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n", "_k")


def islands(regions: DataFrame, by: Sequence[str] = ("chrom",), touching: bool = True) -> DataFrame:
    """Adds island: a running number per group of intervals that overlap (or touch) one another.

    The windows are per chromosome; for a genome-wide table pre-merge with islands_merged(), which works bin by bin.
    """
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | ((F.col("start") > reach) if touching else (F.col("start") >= reach))
    return regions.withColumn("_opens", opens.cast("long")).withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_opens")


def islands_merged(regions: DataFrame, tile: int = 1_000_000) -> DataFrame:
    """Disjoint (chrom, start, end) that cover the same bases.

    Intervals are cut at tile borders and merged within tiles, which spreads a chromosome over many tasks; what then
    touches at a border is one run of few pieces per tile.
    """
    cut = regions.where("end > start").select("chrom", "start", "end").distinct().withColumn("_t", F.explode(bins_of(F.col("start"), F.col("end"), tile)))
    cut = cut.select("chrom", "_t", F.greatest("start", F.col("_t") * tile).alias("start"), F.least("end", (F.col("_t") + 1) * tile).alias("end"))
    return islands(cut, ("chrom", "_t")).groupBy("chrom", "_t", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chrom", "start", "end")


def merged_size(regions: DataFrame) -> DataFrame:
    """One row: total_size, the bases that the union of regions covers."""
    return islands_merged(regions).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("total_size"))


def coverage(regions: DataFrame, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, chrom, start, end, value): the summed weight of the intervals over each run of bases; zero runs omitted.

    A sweep over +weight at starts and -weight at ends, aggregated per position before it is ordered; equal
    neighbours are one run, since positions whose changes cancel are dropped.
    """
    w = F.col(weight) if weight else F.lit(1)
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), w.alias("d")), F.struct(F.col("end").alias("pos"), (-w).alias("d"))))
    steps = regions.where("end > start").select(*by, "chrom", ends.alias("e")).groupBy(*by, "chrom", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    order = Window.partitionBy(*by, "chrom").orderBy("pos")
    swept = steps.withColumn("value", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("pos").over(order))
    return swept.where("value <> 0 and end is not null").select(*by, "chrom", F.col("pos").alias("start"), "end", "value")


def coalesce_runs(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adjacent runs (chrom, start, end, value) with equal values as one."""
    order = Window.partitionBy(*by, "chrom").orderBy("start")
    fresh = F.when((F.lag("end").over(order) == F.col("start")) & (F.lag("value").over(order) == F.col("value")), 0).otherwise(1)
    grouped = runs.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "chrom", "_g", "value").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*by, "chrom", "start", "end", "value")


def fit_to_bin(regions: DataFrame, width: int) -> DataFrame:
    """Starts down and ends up to multiples of width (unchanged if it is at most 1)."""
    if width <= 1:
        return regions
    return regions.withColumns({"start": F.col("start") - F.col("start") % width, "end": (F.ceil(F.col("end") / width) * width).cast("long")})


def clip(regions: DataFrame, chroms: DataFrame) -> DataFrame:
    """Regions on known chromosomes that begin on them; ends are cut to the chromosome."""
    return regions.join(F.broadcast(chroms.select("chrom", "length")), "chrom").where("start < length").withColumn("end", F.least("end", "length")).drop("length")


def recentre(peaks: DataFrame, half: int) -> DataFrame:
    """[summit - half, summit + half + 1) for peaks with a summit column; starts stop at 0."""
    return peaks.withColumns({"start": F.greatest(F.lit(0), F.col("summit") - half), "end": F.col("summit") + half + 1})


def extend_weights(start: int, end: int, left: int, right: int) -> list[tuple[int, int, int]]:
    """(start, end, weight): how many of the windows [p - left, p + right] centred in [start, end) cover each base."""
    change: dict[int, int] = {}
    for p in range(start, end):
        lo = max(0, p - left)
        change[lo] = change.get(lo, 0) + 1
        change[p + right + 1] = change.get(p + right + 1, 0) - 1
    out, value, last = [], 0, None
    for at in sorted(k for k, v in change.items() if v):
        if value:
            out.append((last, at, value))
        value, last = value + change[at], at
    return out


def smooth(runs: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Centred moving average of `width` bases of runs (start, end, value), zeros included, as new runs.

    A run's smoothed shape is piecewise linear, so that each base where it changes gets a second difference; the
    ramps are at most `width` bases long and are spelt out base by base.
    """
    left = (width - 1) // 2
    right = width - 1 - left
    spread = runs.select(*by, "chrom", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - right), F.col("end") - 1 + left)).alias("pos"), "start", "end", "value")
    share = F.least("end", F.col("pos") + right + 1) - F.greatest("start", F.col("pos") - left)
    per_base = spread.withColumn("v", share * F.col("value") / F.lit(float(width))).groupBy(*by, "chrom", "pos").agg(F.sum("v").alias("value"))
    return coalesce_runs(per_base.select(*by, "chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.round("value", 10).alias("value")), by)
