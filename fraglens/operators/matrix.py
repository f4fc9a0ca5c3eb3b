"""Count matrices as long tables (cell, feature, value), and what is computed on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraglens.operators.counting import BIN, region_sums
from fraglens.operators.fragments import insertion_sites, size_filter
from fraglens.operators.intervals import overlap_flag, overlap_join
from fraglens.schemas import genome_index

STRATEGIES = ("insertion", "fragment", "paired-insertion")


def _tiles(strategy: str, width: int) -> Column:
    """Tiles that a fragment counts in; single-end fragments always count by insertion."""
    first, last = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    if strategy == "insertion":
        paired = F.array(first, last)
    elif strategy == "fragment":
        paired = F.sequence(first, last)
    elif strategy == "paired-insertion":
        paired = F.array_distinct(F.array(first, last))
    else:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    return F.when(F.col("strand").isNull(), paired).when(F.col("strand") == "+", F.array(first)).otherwise(F.array(last))


def tile_matrix(frags: DataFrame, chroms: DataFrame, width: int = 500, strategy: str = "paired-insertion", exclude: Sequence[str] = (), min_size: int | None = None, max_size: int | None = None, group: str = "barcode") -> DataFrame:
    """(group, chrom, tile, feature_id, value): one narrow stage, then one shuffle with counts combined before it.

    feature_id runs over the tiles of the chromosomes that aren't excluded.
    """
    kept = chroms.where(~F.col("chrom").isin(*exclude)) if exclude else chroms
    index = genome_index(kept, width).select("chrom", "offset")
    dealt = size_filter(frags, min_size, max_size).where("end > start").select(group, "chrom", F.explode(_tiles(strategy, width)).alias("tile"))
    counts = dealt.groupBy(group, "chrom", "tile").agg(F.count("*").alias("value"))
    return counts.join(F.broadcast(index), "chrom").select(group, "chrom", "tile", (F.col("offset") + F.col("tile")).alias("feature_id"), "value")


def region_matrix(frags: DataFrame, regions: DataFrame, strategy: str = "paired-insertion", group: str = "barcode", width: int = BIN) -> DataFrame:
    """(group, region_id, value) of fragments over regions (chrom, start, end, region_id).

    For paired insertions the second one only counts in regions that don't hold the first. Counts come from running sums in
    bins of `width` bases, so no pair of a fragment and a region is made.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    rows = frags.where("end > start")
    whole = F.col("strand").isNull() if strategy != "insertion" else F.lit(False)
    at = F.explode(F.when(whole, F.array(F.struct(F.col("start").alias("a"), (F.col("end") - 1).alias("b")))).otherwise(F.transform(insertion_sites(F.col("strand"), F.col("start"), F.col("end")), lambda p: F.struct(p.alias("a"), p.alias("b")))))
    placed = rows.select(group, "chrom", at.alias("i")).select(group, "chrom", F.col("i.a").alias("start"), F.col("i.b").alias("last"), F.lit(1).cast("long").alias("value"))
    return region_sums(placed, regions, ["value"], group, {"insertion": None, "fragment": "all", "paired-insertion": "ending"}[strategy], width)


def regions_from_tiles(tiles: DataFrame, regions: DataFrame, width: int, group: str = "barcode") -> DataFrame:
    """(group, region_id, value): each tile's value counts in every region that overlaps it."""
    placed = tiles.select(group, "chrom", (F.col("tile") * width).alias("start"), ((F.col("tile") + 1) * width - 1).alias("last"), F.lit(1).cast("long").alias("_n"), "value")
    return region_sums(placed, regions, ["_n", "value"], group, "all", max(width, BIN)).drop("_n")


def gene_matrix(frags: DataFrame, domains: DataFrame, strategy: str = "paired-insertion", group: str = "barcode") -> DataFrame:
    """(group, gene, value): counts over each transcript's domain (tx_id, gene), of which the largest stands."""
    counts = region_matrix(frags, domains.withColumn("region_id", F.col("tx_id")), strategy, group, 2 * BIN)
    return counts.join(domains.select(F.col("tx_id").alias("region_id"), "gene"), "region_id").groupBy(group, "gene").agg(F.max("value").alias("value"))


def base_value(kind: str, methyl: Column | str = "methyl", total: Column | str = "total") -> Column:
    """target, total, or fraction (0 without the target, 1 for a target without total) of a base."""
    m, t = (F.col(c) if isinstance(c, str) else c for c in (methyl, total))
    if kind == "target":
        return m.cast("double")
    if kind == "total":
        return t.cast("double")
    if kind == "fraction":
        return F.when(m == 0, 0.0).when(t == 0, 1.0).otherwise(m.cast("double") / F.nullif(t, F.lit(0)))
    raise ValueError("kind is target, total or fraction")


def pack_ratio(methyl: Column, total: Column) -> Column:
    """Both numbers in one int: methyl in the high 16 bits."""
    return F.shiftleft(methyl.cast("int"), 16).bitwiseOR(total.cast("int"))


def unpack_ratio(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, 16), packed.bitwiseAND(65535)


def _summary(mode: str, value: Column) -> Column:
    return {"sum": F.sum(value), "mean": F.avg(value), "count": F.count(value).cast("double")}[mode]


def base_value_tiles(values: DataFrame, width: int, kind: str = "fraction", mode: str = "mean", exclude: Sequence[str] = (), group: str = "barcode") -> DataFrame:
    """(group, chrom, tile, value) of base values (chrom, pos, methyl, total)."""
    kept = values.where(~F.col("chrom").isin(*exclude)) if exclude else values
    return kept.groupBy(group, "chrom", F.floor(F.col("pos") / width).cast("long").alias("tile")).agg(_summary(mode, base_value(kind)).alias("value"))


def base_value_regions(values: DataFrame, regions: DataFrame, kind: str = "fraction", mode: str = "mean", group: str = "barcode") -> DataFrame:
    """(group, region_id, value) of base values over regions."""
    v = base_value(kind)
    points = values.select(group, "chrom", F.col("pos").alias("start"), F.col("pos").alias("last"), F.lit(1).cast("long").alias("_n"), v.isNotNull().cast("long").alias("_m"), F.coalesce(v, F.lit(0.0)).alias("_v"))
    total = region_sums(points, regions, ["_n", "_m", "_v"], group)
    value = {"sum": F.when(F.col("_m") > 0, F.col("_v")), "mean": F.try_divide("_v", F.col("_m").cast("double")), "count": F.col("_m").cast("double")}[mode]
    return total.select(group, "region_id", value.alias("value"))


def contact_matrix(contacts: DataFrame, chroms: DataFrame, width: int = 500_000) -> DataFrame:
    """(barcode, feature_id, value): contact counts over pairs of bins; feature_id is bin1 * bins + bin2."""
    index = genome_index(chroms, width)
    n = index.agg(F.sum("n_bins")).first()[0] or 0
    side = lambda k: F.broadcast(index.select(F.col("chrom").alias(f"chrom{k}"), F.col("offset").alias(f"_o{k}")))
    at = lambda k: F.col(f"_o{k}") + F.floor(F.col(f"start{k}") / width)
    placed = contacts.join(side(1), "chrom1").join(side(2), "chrom2")
    return placed.groupBy("barcode", (at(1) * n + at(2)).cast("long").alias("feature_id")).agg(F.sum("count").cast("long").alias("value"))


def aggregate_x(x: DataFrame, groups: DataFrame | None = None, normalize: str | None = None, sizes: DataFrame | None = None, cell: str = "barcode", feature: str = "feature_id") -> DataFrame:
    """(group, feature, value): sums over the cells of each group (cell, group), as they are, per million, or RPKM."""
    grouped = x.join(groups, cell) if groups is not None else x.withColumn("group", F.lit("all"))
    sums = grouped.groupBy("group", feature).agg(F.sum("value").cast("double").alias("value"))
    if normalize is None:
        return sums
    totals = sums.groupBy("group").agg(F.sum("value").alias("_t"))
    out = sums.join(totals, "group").withColumn("value", F.col("value") / (F.col("_t") / 1e6)).drop("_t")
    if normalize == "RPKM":
        out = out.join(sizes.select(feature, "size"), feature).withColumn("value", F.col("value") / (F.col("size") / 1000.0)).drop("size")
    return out.select("group", feature, "value")


def feature_counts(x: DataFrame, feature: str = "feature_id") -> DataFrame:
    return x.groupBy(feature).agg(F.sum("value").cast("double").alias("count"))


def idf(x: DataFrame, variant: str = "log", cell: str = "barcode", feature: str = "feature_id") -> DataFrame:
    """(feature, weight). log: ln(n / df), with df 0 as 1 and df n as n - 1, all 1 if all df are equal; plus_one:
    ln(n / (1 + df)); lsi: ln(1 + n / (sum + 1e-5))."""
    n = x.select(cell).distinct().agg(F.count("*").cast("double").alias("_n"))
    df = x.where("value <> 0").groupBy(feature).agg(F.countDistinct(cell).cast("double").alias("_df"), F.sum("value").cast("double").alias("_s"))
    joined = df.join(F.broadcast(n))
    if variant == "plus_one":
        return joined.select(feature, F.log(F.col("_n") / (1 + F.col("_df"))).alias("weight"))
    if variant == "lsi":
        return joined.select(feature, F.log(1 + F.col("_n") / (F.col("_s") + 1e-5)).alias("weight"))
    spread = df.agg((F.min("_df") == F.max("_df")).alias("_same"))
    used = F.when(F.col("_df") == F.col("_n"), F.col("_df") - 1).otherwise(F.col("_df"))
    weight = F.when(F.col("_same"), 1.0).otherwise(F.log(F.col("_n") / F.nullif(used, F.lit(0.0))))
    return joined.join(F.broadcast(spread)).select(feature, weight.alias("weight"))


def tf_idf(x: DataFrame, weights: DataFrame, cell: str = "barcode", feature: str = "feature_id") -> DataFrame:
    """Values times their feature's weight, rows of unit length."""
    w = x.join(weights, feature).withColumn("value", F.col("value") * F.col("weight"))
    norms = w.groupBy(cell).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    return w.join(norms, cell).select(cell, feature, F.try_divide(F.col("value"), F.col("_norm")).alias("value"))


def accessible(counts: DataFrame, n: int, low: float = 0.005, high: float = 0.005, feature: str = "feature_id") -> DataFrame:
    """The n features with the largest counts after trimming both ends of the non-zero ones by position; ties by id.

    Positions come from counts per value, so that only the boundary values are ranked, not all features at once.
    """
    some = counts.where("count > 0")
    by_value = some.groupBy("count").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("count").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = some.join(by_value.withColumn("_before", before).select("count", "_before"), "count").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("count").orderBy(feature)) - 1)
    total = some.agg(F.count("*").alias("_n"))
    lo, hi = F.floor(F.lit(low) * F.col("_n")), F.col("_n") - F.floor(F.lit(high) * F.col("_n"))
    trimmed = placed.join(F.broadcast(total)).where((F.col("_rank") >= lo) & (F.col("_rank") < hi))
    return trimmed.where(F.col("_rank") >= hi - n).select(feature, "count")


def select_features(x: DataFrame, n: int = 500_000, low: float = 0.005, high: float = 0.005, blacklist: DataFrame | None = None, whitelist: DataFrame | None = None, regions: DataFrame | None = None, feature: str = "feature_id") -> DataFrame:
    """(feature, count, selected). regions places features, for the lists; whitelisted ones with counts always count."""
    counts = feature_counts(x, feature)
    top = accessible(counts, n, low, high, feature).select(feature, F.lit(True).alias("selected"))
    out = counts.join(top, feature, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    for region_list, name in ((blacklist, "black"), (whitelist, "white")):
        if region_list is not None:
            flags = overlap_flag(regions.select("chrom", "start", "end", feature), region_list, name=name).select(feature, name)
            out = out.join(flags, feature, "left").withColumn(name, F.coalesce(name, F.lit(False)))
            keep = F.col("selected") & ~F.col(name) if name == "black" else F.col("selected") | (F.col(name) & (F.col("count") > 0))
            out = out.withColumn("selected", keep).drop(name)
    return out


def variable_features(x: DataFrame, groups: DataFrame, n: int, cell: str = "barcode", feature: str = "feature_id") -> DataFrame:
    """The n features whose log(1 + RPM) varies most between groups; absent values are 0; ties by id."""
    rpm = aggregate_x(x, groups, "RPM", cell=cell, feature=feature)
    k = groups.select("group").distinct().agg(F.count("*").cast("double").alias("_k"))
    v = F.log1p("value")
    sums = rpm.groupBy(feature).agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q")).join(F.broadcast(k))
    var = F.col("_q") / F.col("_k") - (F.col("_s") / F.col("_k")) ** 2
    return sums.select(feature, F.greatest(var, F.lit(0.0)).alias("variance")).orderBy(F.desc(F.round("variance", 9)), feature).limit(n)


def normalised_coverage(frags: DataFrame, width: int = 10, normalization: str | None = "RPKM", chroms: DataFrame | None = None, blacklist: DataFrame | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """(by, chrom, start, end, value): binned coverage. The totals are of fragment lengths, before binning."""
    from fraglens.operators.intervals import clip, coverage, fit_to_bin

    if blacklist is not None:
        frags = overlap_join(frags, blacklist, how="left_anti")
    counted = frags
    if include:
        counted = counted.where(F.col("chrom").isin(*include))
    if exclude:
        counted = counted.where(~F.col("chrom").isin(*exclude))
    binned = fit_to_bin(frags, width)
    runs = coverage(clip(binned, chroms) if chroms is not None else binned, by=by)
    if normalization is None:
        return runs.withColumn("value", F.col("value").cast("double"))
    size = F.sum(F.col("end") - F.col("start")).cast("double")
    if normalization == "BPM":
        total = runs.groupBy(*by).agg((F.sum(F.col("value") * F.floor((F.col("end") - F.col("start")) / width)).cast("double") / 1e6).alias("_t"))
    elif normalization in ("RPKM", "CPM"):
        total = counted.groupBy(*by).agg((size * width / 1e9 if normalization == "RPKM" else size / 1e6).alias("_t"))
    else:
        raise ValueError("normalization is RPKM, CPM, BPM or None")
    joined = runs.join(total, list(by)) if by else runs.join(F.broadcast(total))
    return joined.select(*by, "chrom", "start", "end", (F.col("value") / F.col("_t")).alias("value"))
