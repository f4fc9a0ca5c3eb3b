"""Row-wise steps on fragments and transcripts, and per-cell quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraglens.operators.counting import window_profile
from fraglens.operators.intervals import coverage, overlap_join

TSS_WINDOW = 2000


def shift(frags: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """Import shift: starts by left (not below 0); ends by right if paired, by left if single-end."""
    paired = F.col("strand").isNull()
    return frags.withColumns({"start": F.greatest(F.lit(0), F.col("start") + left), "end": F.col("end") + F.when(paired, right).otherwise(left)})


def shift_paired(frags: DataFrame, left: int = 4, right: int = -5) -> DataFrame:
    """Alignment shift: only paired fragments move."""
    paired = F.col("strand").isNull()
    return frags.withColumns({"start": F.when(paired, F.greatest(F.lit(0), F.col("start") + left)).otherwise(F.col("start")), "end": F.when(paired, F.col("end") + right).otherwise(F.col("end"))})


def insertion_sites(strand: Column, start: Column, end: Column) -> Column:
    """Both ends of a paired fragment, the 5' end of a stranded one."""
    return F.when(strand.isNull(), F.array(start, end - 1)).when(strand == "+", F.array(start)).otherwise(F.array(end - 1))


def insertions(frags: DataFrame) -> DataFrame:
    """frags with one row per insertion: pos, and start, end of that base."""
    out = frags.withColumn("pos", F.explode(insertion_sites(F.col("strand"), F.col("start"), F.col("end"))))
    return out.withColumns({"start": F.col("pos"), "end": F.col("pos") + 1})


def known_fragments(frags: DataFrame, chroms: DataFrame, whitelist: DataFrame | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Non-empty fragments on known chromosomes, of whitelisted barcodes."""
    out = frags.where("end > start").join(F.broadcast(chroms.select("chrom")), "chrom", "left_semi")
    if exclude:
        out = out.where(~F.col("chrom").isin(*exclude))
    return out.join(whitelist.select("barcode"), "barcode", "left_semi") if whitelist is not None else out


def size_filter(frags: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Inclusive bounds on the size of paired fragments; single-end ones stay."""
    size, keep = F.col("end") - F.col("start"), F.lit(True)
    if least is not None:
        keep = keep & (size >= least)
    if most is not None:
        keep = keep & (size <= most)
    return frags.where(F.col("strand").isNotNull() | keep)


def cell_qc(frags: DataFrame, mito: Sequence[str] = ("chrM", "M"), group: str = "barcode") -> DataFrame:
    """n_fragment (without mitochondria), frac_dup and frac_mito (null for 0/0) per cell."""
    is_mito = F.col("chrom").isin(*mito)
    g = frags.groupBy(group).agg(F.count(F.when(~is_mito, 1)).alias("n_fragment"), F.count(F.when(is_mito, 1)).alias("_m"), F.sum("count").alias("_total"))
    seen = (F.col("n_fragment") + F.col("_m")).cast("double")
    return g.select(group, "n_fragment", (1 - F.try_divide(seen, F.col("_total").cast("double"))).alias("frac_dup"), F.try_divide(F.col("_m").cast("double"), seen).alias("frac_mito"))


def import_fragments(frags: DataFrame, chroms: DataFrame, min_fragments: int = 200, whitelist: DataFrame | None = None, mito: Sequence[str] = ("chrM", "M"), shift_left: int = 0, shift_right: int = 0) -> tuple[DataFrame, DataFrame]:
    """(fragments, obs) of the cells with enough fragments."""
    kept = known_fragments(shift(frags, shift_left, shift_right), chroms, whitelist)
    obs = cell_qc(kept, mito).where(F.col("n_fragment") >= min_fragments)
    return kept.where(~F.col("chrom").isin(*mito)).join(obs.select("barcode"), "barcode", "left_semi"), obs


def filter_cells(obs: DataFrame, min_counts: int | None = 1000, min_tsse: float | None = 5.0, max_counts: int | None = None, max_tsse: float | None = None) -> DataFrame:
    """Cells within the bounds; None leaves a bound out."""
    for column, low, high in (("n_fragment", min_counts, max_counts), ("tsse", min_tsse, max_tsse)):
        if low is not None:
            obs = obs.where(F.col(column) >= low)
        if high is not None:
            obs = obs.where(F.col(column) <= high)
    return obs


def fragment_file_qc(frags: DataFrame, mito: Sequence[str] = ("chrM", "M")) -> DataFrame:
    """One row: duplicates, and shares of nucleosome-free (under 147) and mono-nucleosome (147 to 294) fragments."""
    size, free = F.col("end") - F.col("start"), ~F.col("chrom").isin(*mito)
    n = F.count("*").cast("double")
    share = lambda c: F.try_divide(F.count(F.when(free & c, 1)).cast("double"), n)
    return frags.agg((1 - F.try_divide(n, F.sum("count").cast("double"))).alias("frac_duplicates"), share(size < 147).alias("frac_nfr"), share((size >= 147) & (size <= 294)).alias("frac_mono"))


def size_distribution(frags: DataFrame, most: int = 1000) -> DataFrame:
    """(size, n) for 0..most of paired fragments; 0 counts the larger ones."""
    size = F.col("end") - F.col("start")
    counts = frags.where("strand is null").groupBy(F.when(size > most, 0).otherwise(size).cast("long").alias("size")).agg(F.count("*").alias("n"))
    axis = frags.sparkSession.range(most + 1).withColumnRenamed("id", "size")
    return axis.join(counts, "size", "left").select("size", F.coalesce("n", F.lit(0)).alias("n"))


def chrom_summary(values: DataFrame, chroms: Sequence[str], mode: str = "sum", value: str | None = None, group: str = "barcode") -> DataFrame:
    """One column per chromosome: sum, count or mean of values (1 for fragments) per cell; 0 where there are none."""
    v = F.col(value) if value else F.lit(1)
    agg = {"sum": F.sum(v), "count": F.count(v), "mean": F.avg(v)}[mode].cast("double")
    return values.groupBy(group).pivot("chrom", list(chroms)).agg(agg).fillna(0.0)


def promoters(tx: DataFrame, upstream: int = 2000, downstream: int = 0, body: bool = True) -> DataFrame:
    """Regulatory domains: upstream of the start, to downstream of the end (body) or of the start."""
    left, right = F.col("left") - 1, F.col("right") - 1
    plus_end = (right if body else left) + downstream
    minus_start = (left if body else right) - downstream
    start = F.when(F.col("strand") == "+", F.greatest(F.lit(0), left - upstream)).when(F.col("strand") == "-", F.greatest(F.lit(0), minus_start))
    end = F.when(F.col("strand") == "+", plus_end).when(F.col("strand") == "-", right + upstream)
    return tx.withColumns({"start": F.coalesce(start, F.raise_error("transcript without a strand").cast("long")), "end": end})


def tss(tx: DataFrame) -> DataFrame:
    """(chrom, tss, forward) of stranded transcripts, each once."""
    at = F.when(F.col("strand") == "+", F.col("left") - 1).when(F.col("strand") == "-", F.col("right") - 1)
    return tx.select("chrom", at.alias("tss"), (F.col("strand") == "+").alias("forward")).where("tss is not null").distinct()


def tss_hits(frags: DataFrame, sites: DataFrame, window: int = TSS_WINDOW, group: str = "barcode") -> DataFrame:
    """(group, pos, n): insertions by their place in TSS windows, mirrored for reverse genes."""
    regions = sites.select("chrom", F.greatest(F.lit(0), F.col("tss") - window).alias("start"), (F.col("tss") + window + 1).alias("end"), "forward")
    points = insertions(frags).groupBy(group, "chrom", "start").agg(F.count("*").alias("n"))
    return window_profile(points, regions, group)


def tsse(frags: DataFrame, sites: DataFrame, window: int = TSS_WINDOW, group: str = "barcode") -> DataFrame:
    """tsse per cell: mean of the 11 central counts over the background of both outer 100, plus 0.1; 0 without hits.

    The stretches of all windows that count are summed to one row per base, which an insertion meets at most once.
    """
    base, end = F.greatest(F.lit(0), F.col("tss") - window), F.col("tss") + window + 1
    right = max(2 * window - 99, 100)

    def stretch(lo: int, hi: int, central: bool) -> Column:
        """Places lo..hi of a window, which are mirrored for reverse genes."""
        start = F.when(F.col("forward"), base + lo).otherwise(F.greatest(base, end - 1 - hi))
        stop = F.when(F.col("forward"), F.least(end, base + hi + 1)).otherwise(end - lo)
        return F.struct(start.alias("start"), stop.alias("end"), F.lit(central).alias("central"))

    parts = F.explode(F.array(stretch(window - 5, window + 5, True), stretch(0, 99, False), stretch(right, 2 * window, False)))
    narrow = sites.select("chrom", parts.alias("s")).select("chrom", "s.start", "s.end", "s.central").where("start < end")
    runs = coverage(narrow, by=["central"])
    n = lambda central: F.sum(F.when(F.col("central") == central, F.col("value")).otherwise(0))
    bases = runs.select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("start"), "central", "value").groupBy("chrom", "start").agg(n(True).alias("central"), n(False).alias("outer"))
    met = insertions(frags).select(group, "chrom", "start").join(bases, ["chrom", "start"])
    centre = F.sum("central").cast("double") / 11
    outer = F.sum("outer").cast("double") / 200 + 0.1
    scored = met.groupBy(group).agg((centre / outer).alias("tsse"))
    return frags.select(group).distinct().join(scored, group, "left").select(group, F.coalesce("tsse", F.lit(0.0)).alias("tsse"))


def tss_profile(frags: DataFrame, sites: DataFrame, window: int = TSS_WINDOW, half: int = 5) -> DataFrame:
    """(pos, n, smoothed) over the window: library counts and their moving average, which shrinks at the ends."""
    counts = tss_hits(frags.withColumn("_all", F.lit(1)), sites, window, "_all").groupBy("pos").agg(F.sum("n").alias("n"))
    axis = frags.sparkSession.range(2 * window + 1).withColumnRenamed("id", "pos")
    dense = axis.join(counts, "pos", "left").select("pos", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return dense.withColumn("smoothed", F.avg("n").over(Window.orderBy("pos").rowsBetween(-half, half)))


def tss_overlap(frags: DataFrame, sites: DataFrame, window: int = TSS_WINDOW) -> DataFrame:
    """One row: n_insertions, n_overlapping, frac_overlap_tss over the library."""
    from fraglens.operators.intervals import islands_merged

    regions = sites.select("chrom", F.greatest(F.lit(0), F.col("tss") - window).alias("start"), (F.col("tss") + window + 1).alias("end"))
    sites_ = insertions(frags).groupBy("chrom", "start", "end").agg(F.count("*").alias("n"))
    inside = overlap_join(sites_, islands_merged(regions), 2 * window).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_overlapping"))
    return sites_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_insertions")).join(F.broadcast(inside)).withColumn("frac_overlap_tss", F.try_divide(F.col("n_overlapping").cast("double"), F.col("n_insertions").cast("double")))


def frip(frags: DataFrame, regions: DataFrame, normalized: bool = True, count_insertions: bool = False, group: str = "barcode") -> DataFrame:
    """(group, frip): the share (or number) of a cell's fragments or insertions that overlap any region; rows aren't grouped before."""
    rows = (insertions(frags) if count_insertions else frags).select(group, "chrom", "start", "end")
    hit = overlap_join(rows, regions, how="left_semi").groupBy(group).agg(F.count("*").alias("hits"))
    per_cell = rows.groupBy(group).agg(F.count("*").alias("all")).join(hit, group, "left")
    hits = F.coalesce("hits", F.lit(0)).cast("double")
    return per_cell.select(group, (hits / F.col("all") if normalized else hits).alias("frip"))


def prefilter(frags: DataFrame, least: int, whitelist: DataFrame | None = None) -> DataFrame:
    """Fragments of barcodes with at least `least` records as they were read, before any other filter, that are whitelisted if there is a list."""
    known = frags.groupBy("barcode").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("barcode")
    if whitelist is not None:
        known = known.join(whitelist, "barcode", "left_semi")
    return frags.join(known, "barcode", "left_semi")
