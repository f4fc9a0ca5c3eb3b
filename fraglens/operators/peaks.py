"""Peaks: calling, merging, and reproducibility across replicates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraglens.functions.tails import poisson_sf
from fraglens.operators.fragments import insertions
from fraglens.operators.intervals import clip, coverage, islands, overlap_join, recentre


def merge_peaks(peaks: DataFrame, chroms: DataFrame, half: int = 250) -> tuple[DataFrame, DataFrame]:
    """(merged, membership) of peaks (group, chrom, start, end, summit, p_value).

    Peaks are resized around their summits; in each block of overlapping ones the best is taken and drops those that
    overlap it, until none is left. Blocks are independent. membership has a boolean column per group: whether one of
    its original peaks overlaps the merged one.
    """
    sized = islands(recentre(peaks, half), touching=False)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p_value", "start", "end"], ascending=[False, True, True])
        kept: list[tuple[int, int]] = []
        rows = []
        for r in pdf.itertuples(index=False):
            if all(r.end <= a or r.start >= b for a, b in kept):
                kept.append((r.start, r.end))
                rows.append((r.chrom, r.start, r.end, r.summit, r.p_value))
        return pd.DataFrame(rows, columns=["chrom", "start", "end", "summit", "p_value"])

    merged = clip(sized.groupBy("chrom", "island").applyInPandas(pick, "chrom string, start long, end long, summit long, p_value double"), chroms)
    met = overlap_join(merged.select("chrom", "start", "end"), peaks.select("chrom", "start", "end", "group"))
    names = sorted(r[0] for r in peaks.select("group").distinct().collect())
    member = met.groupBy("chrom", "start", "end").pivot("r_group", names).agg(F.lit(True)).fillna(False)
    return merged, member


def reproducible(peaks: DataFrame, replicates: list[DataFrame], blacklist: DataFrame | None = None) -> DataFrame:
    """Peaks outside the blacklist that overlap a peak of every replicate."""
    if blacklist is not None:
        peaks = overlap_join(peaks, blacklist, how="left_anti")
    for r in replicates:
        peaks = overlap_join(peaks, r, how="left_semi")
    return peaks


def narrow_table(peaks: DataFrame) -> DataFrame:
    """Ten-column peaks: score at most 1000, negative p and q as null, the summit as an offset."""
    return peaks.select("chrom", "start", "end", "name", F.least(F.lit(1000), (F.col("score") * 10).cast("int")).alias("score"), F.lit(".").alias("strand"), "signal_value", F.when(F.col("p_value") >= 0, F.col("p_value")).alias("p_value"), F.when(F.col("q_value") >= 0, F.col("q_value")).alias("q_value"), (F.col("summit") - F.col("start")).alias("peak"))


def call_peaks(frags: DataFrame, chroms: DataFrame, q_value: float = 0.05, shift: int = -100, extend: int = 200, max_gap: int = 30, min_len: int | None = None, local: int = 10_000, group: str = "group") -> DataFrame:
    """(group, chrom, start, end, summit, signal, p_value, q_value): pile-ups of extended ends against a local rate.

    The rate is the larger of the group's genome mean and its mean over windows of `local` bases; p-values are Poisson
    tails as -log10; q-values rank the distinct (pile-up, rate) levels by the bases that they cover.
    """
    ends = insertions(frags)
    tags = ends.withColumns({"start": F.greatest(F.lit(0), F.col("pos") + shift), "end": F.col("pos") + shift + extend})
    pile = coverage(clip(tags, chroms), by=[group])
    size = chroms.agg(F.sum("length").cast("double").alias("_g"))
    mean = ends.groupBy(group).agg(F.count("*").alias("_n")).join(F.broadcast(size)).select(group, (F.col("_n") * extend / F.col("_g")).alias("_mean"))
    window = ends.groupBy(group, "chrom", F.floor(F.col("pos") / local).alias("_w")).agg((F.count("*") * extend / float(local)).alias("_local"))
    rated = pile.withColumn("_w", F.floor(F.col("start") / local)).join(window, [group, "chrom", "_w"], "left").join(mean, group)
    rated = rated.withColumn("rate", F.round(F.greatest("_mean", F.coalesce("_local", F.lit(0.0))), 6))
    levels = rated.groupBy(group, F.col("value").cast("int").alias("value"), "rate").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))

    def tails(it):
        for pdf in it:
            p = [-math.log10(max(poisson_sf(int(v), float(r)), 1e-300)) for v, r in zip(pdf["value"], pdf["rate"], strict=True)]
            yield pdf.assign(p_value=np.array(p, dtype=float))

    kind = dict(frags.dtypes)[group]
    scored = levels.mapInPandas(tails, f"{group} {kind}, value int, rate double, bases long, p_value double")
    up = Window.partitionBy(group).orderBy(F.desc("p_value"), "value", "rate").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(group).orderBy(F.desc("p_value"), "value", "rate").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("bases").over(Window.partitionBy(group))
    raw = F.col("p_value") - F.log10(total / F.sum("bases").over(up))
    scored = scored.withColumn("_q", raw).withColumn("q_value", F.greatest(F.lit(0.0), F.min("_q").over(down)))
    hot = rated.withColumn("value", F.col("value").cast("int")).join(scored.select(group, "value", "rate", "p_value", "q_value"), [group, "value", "rate"]).where(F.col("q_value") >= -math.log10(q_value))
    order = Window.partitionBy(group, "chrom").orderBy("start")
    opens = F.when(F.col("start") - F.lag("end").over(order) <= max_gap, 0).otherwise(1)
    runs = hot.withColumn("_o", opens).withColumn("_i", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct(((F.col("start") + F.col("end")) / 2).cast("long").alias("summit"), "value", "rate", "p_value", "q_value"), F.struct("value", -F.col("start")))
    out = runs.groupBy(group, "chrom", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("b")).where(F.col("end") - F.col("start") >= (min_len if min_len is not None else extend))
    return out.select(group, "chrom", "start", "end", "b.summit", (F.col("b.value") / F.col("b.rate")).alias("signal"), "b.p_value", "b.q_value")
