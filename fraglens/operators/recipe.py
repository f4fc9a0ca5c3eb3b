"""Quality figures of a whole library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglens.operators.fragments import frip, tss_overlap, tsse
from fraglens.operators.integrate import called
from fraglens.operators.intervals import islands_merged
from fraglens.operators.peaks import call_peaks
from fraglens.operators.steps import cut


def library_metrics(frags: DataFrame, chroms: DataFrame, sites: DataFrame, peaks: DataFrame | None = None, q_value: float = 0.001) -> DataFrame:
    """One row of figures of fragments (a bag) against start sites (chrom, tss, forward) and peaks (chrom, start, end).

    Peaks are called over all fragments if none are given; cells are called by the fragments that overlap peaks. Shares
    of nothing are null.
    """
    if peaks is None:
        peaks = cut(call_peaks(frags.withColumn("group", F.lit("all")), chroms, q_value).select("chrom", "start", "end"))
    per = frags.groupBy("barcode").agg(F.count("*").alias("n_fragment"))
    inside = frip(frags, peaks, normalized=False).select("barcode", F.col("frip").alias("n_in_peaks"))
    cuts = frip(frags, peaks, normalized=False, count_insertions=True).select("barcode", F.col("frip").alias("n_cuts"))
    cells = cut(per.join(inside, "barcode", "left").join(cuts, "barcode", "left").join(tsse(frags, sites).select("barcode", "tsse"), "barcode", "left").fillna(0, ["n_in_peaks", "n_cuts"]))
    chosen = called(cells, "n_in_peaks")
    total = cells.agg(F.sum("n_fragment").alias("_all"), F.try_divide(F.sum("n_in_peaks").cast("double"), F.sum("n_fragment")).alias("frac_in_peaks"))
    inner = chosen.agg(
        F.count("*").alias("n_cells"), F.percentile("n_fragment", F.lit(0.5)).alias("median_fragments"), F.percentile("tsse", F.lit(0.5)).alias("median_tsse"),
        F.sum("n_fragment").alias("_in"), F.try_divide(F.sum("n_cuts").cast("double"), 2 * F.sum("n_fragment")).alias("frac_cuts_in_peaks"),
    )
    merged = islands_merged(peaks.select("chrom", "start", "end"))
    area = merged.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("_area")).join(F.broadcast(chroms.agg(F.sum("length").alias("_size"))))
    near = tss_overlap(frags, sites).select("frac_overlap_tss")
    out = inner.join(F.broadcast(total)).join(F.broadcast(area)).join(F.broadcast(peaks.agg(F.count("*").alias("n_peaks")))).join(F.broadcast(near))
    return out.select("n_cells", "median_fragments", "median_tsse", F.try_divide(F.col("_in").cast("double"), "_all").alias("frac_fragments_in_cells"), "frac_in_peaks", "frac_cuts_in_peaks", "n_peaks", F.try_divide(F.col("_area").cast("double"), "_size").alias("frac_genome_in_peaks"), "frac_overlap_tss")
