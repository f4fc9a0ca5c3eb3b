"""Ranks, adjusted p-values, differential tests, marker regions and similarity."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraglens.functions.tails import chi2_1_sf, normal_upper_z
from fraglens.operators.products import largest_difference, row_products


def average_ranks(rows: DataFrame, key: str = "row", value: str = "value") -> DataFrame:
    """Adds rank: ties share the mean of their places within a key."""
    by_value = rows.groupBy(key, value).agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = by_value.select(key, value, (before + (F.col("_m") + 1) / 2.0).alias("rank"))
    return rows.join(ranks, [key, value])


def adjust_bh(tests: DataFrame, p: str = "p_value", by: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """Adds q_value: Benjamini-Hochberg within each group of `by`."""
    up = Window.partitionBy(*by).orderBy(p, tie)
    down = Window.partitionBy(*by).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = tests.withColumn("_rank", F.row_number().over(up)).withColumn("_n", n)
    return ranked.withColumn("q_value", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(down))).drop("_rank", "_n")


def zscore(rows: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Adds z: population z-score of value within each `by`; null without spread."""
    w = Window.partitionBy(by)
    return rows.withColumn("z", F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def modified_zscore(rows: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Adds z: 0.6745 (x - median) / MAD; a MAD of 0 becomes the smallest positive one."""
    med = rows.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("_med"))
    dev = rows.join(med, by).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = dev.groupBy(by).agg(F.percentile("_dev", F.lit(0.5)).alias("_mad"))
    least = mad.where("_mad > 0").agg(F.min("_mad").alias("_least"))
    return dev.join(mad, by).join(F.broadcast(least)).withColumn("z", 0.6745 * (F.col(value) - F.col("_med")) / F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.col("_least"))).drop("_med", "_dev", "_mad", "_least")


#: The share of rows, each way, within which a sketch of its inverse's accuracy finds a quantile.
SKETCH = 1e-4


def quantiles(rows: DataFrame, shares: Sequence[float], value: str = "value") -> list[float | None]:
    """The exact quantiles of value, interpolated; nulls take no part and NaN is largest.

    A sketch tells between which values each one lies; the values there, a few of ten thousand, are then counted one by
    one and all others together, so no task holds all of them.
    """
    x = rows.select(F.col(value).cast("double").alias("x")).where("x is not null")
    near = [min(1.0, max(0.0, q + d)) for q in shares for d in (-2 * SKETCH, 2 * SKETCH)]
    number = F.when(~F.isnan("x"), F.col("x"))
    seen = x.agg(F.count("*").alias("n"), F.count(number).alias("m"), F.percentile_approx(number, near, int(1 / SKETCH)).alias("ends")).first()
    if not seen.n:
        return [None for _ in shares]
    merged: list[list[float]] = []
    for a, b in sorted(zip(seen.ends[::2], seen.ends[1::2], strict=True)) if seen.m else []:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    place = F.lit(2 * len(merged))
    for k, (a, b) in reversed(list(enumerate(merged))):
        place = F.when(F.col("x") < a, 2 * k).when(F.col("x") <= b, 2 * k + 1).otherwise(place)
    place = F.when(F.isnan("x"), 2 * len(merged)).otherwise(place)
    counted = x.select(place.alias("k"), "x").groupBy("k", F.when(F.col("k") % 2 == 1, F.col("x")).alias("x")).count().toArrow()
    kind, values, counts = (counted.column(c).to_numpy() for c in ("k", "x", "count"))
    order = np.lexsort((values, kind))
    kind, values, total = kind[order], values[order], np.cumsum(counts[order])
    out: list[float | None] = []
    for q in shares:
        position = (seen.n - 1) * q
        ends = []
        for rank in (int(np.floor(position)), int(np.ceil(position))):
            at = int(np.searchsorted(total, rank, side="right"))
            if rank < seen.m and kind[at] % 2 == 0:  # outside of what the sketch has told
                return list(rows.agg(F.percentile(F.col(value).cast("double"), list(shares))).first()[0])
            ends.append(float(values[at]) if rank < seen.m else float("nan"))
        low, high = ends
        out.append(low if low == high else (np.ceil(position) - position) * low + (position - np.floor(position)) * high if position % 1 else low)
    return [float(v) if v is not None else None for v in out]


def clip_quantile(rows: DataFrame, q: float = 0.999, value: str = "value") -> DataFrame:
    """Values capped at their q-quantile."""
    (cap,) = quantiles(rows, [q], value)
    return rows.withColumn(value, F.least(value, F.lit(cap).cast("double")))


def min_max(rows: DataFrame, low: float = 0.01, high: float = 0.90, value: str = "value") -> DataFrame:
    """Values scaled so that the two percentiles are 0 and 1, and cut there."""
    lo, hi = (F.lit(v).cast("double") for v in quantiles(rows, [low, high], value))
    scaled = F.try_divide(F.col(value) - lo, hi - lo)
    return rows.withColumn(value, F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def elbow(values: DataFrame, share: float = 0.01) -> DataFrame:
    """One row: the first i at which the gap to the next of (i, value) is under `share` of the gaps so far."""
    order = Window.orderBy("i")
    gap = F.lag("value").over(order) - F.col("value")
    gaps = values.withColumn("gap", gap).where("gap is not null").withColumn("so_far", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return gaps.where(F.col("gap") < share * F.col("so_far")).agg(F.min("i").alias("elbow"))


def knee_curve(cells: DataFrame, value: str = "n_fragment") -> DataFrame:
    """(value, rank): mean rank, from the largest down, of each distinct count."""
    counts = cells.groupBy(value).agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(value, (before + (F.col("_m") + 1) / 2.0).alias("rank"))


def log_fold_change(x: DataFrame, groups: DataFrame, one: str, two: str, pseudo: float = 1.0, cell: str = "barcode", feature: str = "feature_id") -> DataFrame:
    """(feature, pct1, pct2, log_fc) between two groups (cell, group); features absent from both are left out."""
    sizes = groups.groupBy().agg(F.count(F.when(F.col("group") == one, 1)).alias("_c1"), F.count(F.when(F.col("group") == two, 1)).alias("_c2"))
    g = x.join(groups.where(F.col("group").isin(one, two)), cell)
    part = lambda name, c: F.sum(F.when(F.col("group") == name, c).otherwise(0)).cast("double")
    per = g.groupBy(feature).agg(part(one, F.col("value")).alias("_s1"), part(two, F.col("value")).alias("_s2"), part(one, F.lit(1)).alias("_d1"), part(two, F.lit(1)).alias("_d2"))
    total = per.agg(F.sum(F.col("_s1") + pseudo).alias("_t1"), F.sum(F.col("_s2") + pseudo).alias("_t2"))
    ratio = F.log2(((F.col("_s1") + pseudo) / F.col("_t1")) / ((F.col("_s2") + pseudo) / F.col("_t2")))
    return per.join(F.broadcast(total)).join(F.broadcast(sizes)).select(feature, (F.col("_d1") / F.col("_c1")).alias("pct1"), (F.col("_d2") / F.col("_c2")).alias("pct2"), ratio.alias("log_fc"))


def filter_features(changes: DataFrame, direction: str = "both", min_pct: float = 0.05, min_log_fc: float = 0.25) -> DataFrame:
    """Features detected often enough in either group whose change is large enough in the direction."""
    c = F.col("log_fc")
    signed = {"both": F.abs(c), "positive": c, "negative": -c}[direction]
    return changes.where(((F.col("pct1") >= min_pct) | (F.col("pct2") >= min_pct)) & (signed >= min_log_fc))


def _deviance(design: np.ndarray, y: np.ndarray) -> float:
    """Deviance of the unpenalised logistic fit, by reweighted least squares."""
    beta = np.zeros(design.shape[1])
    for _ in range(60):
        eta = np.clip(design @ beta, -30, 30)
        p = 1 / (1 + np.exp(-eta))
        w = np.maximum(p * (1 - p), 1e-10)
        step = np.linalg.lstsq(design.T @ (design * w[:, None]) + 1e-9 * np.eye(design.shape[1]), design.T @ (y - p), rcond=None)[0]
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ beta, -30, 30))), 1e-12, 1 - 1e-12)
    return float(-2 * (y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def diff_test(x: DataFrame, groups: DataFrame, one: str, two: str, direction: str = "both", min_pct: float = 0.05, min_log_fc: float = 0.25, cell: str = "barcode", feature: str = "feature_id") -> DataFrame:
    """(feature, log_fc, p_value, q_value), ordered by q_value: likelihood-ratio tests of detection on the group.

    The null model has the log total count of a cell as covariate. Each feature is a group of at most as many rows as
    cells; cells without the feature come from the broadcast table of the two groups' cells.
    """
    cells = x.join(groups.where(F.col("group").isin(one, two)), cell).groupBy(cell, "group").agg(F.log1p(F.sum("value").cast("double")).alias("covariate"))
    table = cells.toPandas()
    index = {c: i for i, c in enumerate(table[cell])}
    covariate = table["covariate"].to_numpy()
    is_one = (table["group"] == one).to_numpy(dtype=float)
    chosen = filter_features(log_fold_change(x, groups, one, two, cell=cell, feature=feature), direction, min_pct, min_log_fc)
    null = np.stack([np.ones(len(table)), covariate], axis=1)
    full = np.hstack([null, is_one[:, None]])

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(len(index))
        y[[index[c] for c in pdf[cell] if c in index]] = 1
        gain = max(0.0, _deviance(null, y) - _deviance(full, y))
        return pd.DataFrame({feature: [pdf[feature].iloc[0]], "log_fc": [pdf["log_fc"].iloc[0]], "p_value": [chi2_1_sf(gain)]})

    kind = dict(x.dtypes)[feature]
    rows = x.where("value > 0").select(cell, feature).join(chosen.select(feature, "log_fc"), feature)
    tested = rows.groupBy(feature).applyInPandas(test, f"{feature} {kind}, log_fc double, p_value double")
    return adjust_bh(tested, tie=feature).orderBy("q_value", feature)


def marker_regions(x: DataFrame, groups: DataFrame, sizes: DataFrame, p_value: float = 0.01, cell: str = "barcode", feature: str = "feature_id") -> DataFrame:
    """(group, feature, z): regions whose log2(1 + RPKM) is significantly high in a group; absent values are 0."""
    from fraglens.operators.matrix import aggregate_x

    rpkm = aggregate_x(x, groups, "RPKM", sizes, cell, feature).withColumn("v", F.log2(1 + F.col("value")))
    k = groups.select("group").distinct().agg(F.count("*").cast("double").alias("_k"))
    stat = rpkm.groupBy(feature).agg(F.sum("v").alias("_s"), F.sum(F.col("v") * F.col("v")).alias("_q")).join(F.broadcast(k))
    mean = F.col("_s") / F.col("_k")
    stat = stat.select(feature, mean.alias("_mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_k") - mean * mean)).alias("_sd"))
    z = F.try_divide(F.col("v") - F.col("_mean"), F.col("_sd"))
    return rpkm.join(stat, feature).select("group", feature, z.alias("z")).where(F.col("z") > normal_upper_z(p_value))


def marker_enrichment(x: DataFrame, groups: DataFrame, markers: DataFrame, min_markers: int = 1, cell: str = "barcode", feature: str = "gene") -> DataFrame:
    """(group, marker_set, score): mean z-score of log2(1 + RPM) over the genes (marker_set, gene) that are present."""
    from fraglens.operators.matrix import aggregate_x

    rpm = aggregate_x(x, groups, "RPM", cell=cell, feature=feature).withColumn("value", F.log2(1 + F.col("value")))
    scored = zscore(rpm, feature).join(markers, feature)
    enough = scored.groupBy("marker_set").agg(F.countDistinct(feature).alias("_n")).where(F.col("_n") >= min_markers).select("marker_set")
    return scored.join(enough, "marker_set").groupBy("group", "marker_set").agg(F.avg("z").alias("score"))


def jaccard(x: DataFrame, other: DataFrame | None = None, weights: DataFrame | None = None, row: str = "row", column: str = "column") -> DataFrame:
    """(i, j, value) for the pairs of rows that share a column (others are 0; two empty rows are 1 by convention)."""
    w = lambda d: (d.join(weights, column) if weights is not None else d.withColumn("weight", F.lit(1.0))).where("value <> 0").select(row, column, "weight").distinct()
    a = w(x)
    b = w(other) if other is not None else a
    size = lambda d, name: d.groupBy(F.col(row).alias(name)).agg(F.sum("weight").alias(f"_s{name}"))
    value = lambda d, c: d.select(row, column, c.alias("value"))
    shared = row_products(value(a, F.col("weight")), value(b, F.lit(1.0)), row=row, column=column).withColumnRenamed("value", "_w")
    return shared.join(size(a, "i"), "i").join(size(b, "j"), "j").select("i", "j", (F.col("_w") / (F.col("_si") + F.col("_sj") - F.col("_w"))).alias("value"))


def cosine(x: DataFrame, other: DataFrame | None = None, weights: DataFrame | None = None, row: str = "row", column: str = "column") -> DataFrame:
    """(i, j, value) for the pairs of rows that share a column; weights multiply the products."""

    def scaled(d: DataFrame) -> DataFrame:
        d = d.join(weights, column).withColumn("value", F.col("value") * F.sqrt("weight")) if weights is not None else d
        norm = d.groupBy(row).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n")).where("_n > 0")
        return d.join(norm, row).select(row, column, (F.col("value") / F.col("_n")).alias("value"))

    a = scaled(x)
    b = scaled(other) if other is not None else a
    return row_products(a, b, row=row, column=column)


def pearson(x: DataFrame, other: DataFrame | None = None, row: str = "row", column: str = "column") -> DataFrame:
    """(i, j, value) for dense rows (every row has every column); null without spread, cut to [-1, 1]."""
    r = F.col("value")
    return row_products(x, other if other is not None else x, True, row, column).select("i", "j", F.when(r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))).alias("value"))


def spearman(x: DataFrame, other: DataFrame | None = None, row: str = "row", column: str = "column") -> DataFrame:
    """Pearson correlation of average ranks."""
    ranked = lambda d: average_ranks(d, row).select(row, column, F.col("rank").alias("value"))
    return pearson(ranked(x), ranked(other) if other is not None else None, row, column)


def linear_fit(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: slope and intercept."""
    return points.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def shannon(rows: DataFrame, by: str, category: str) -> DataFrame:
    """(by, diversity): -sum p ln p of the categories' shares."""
    counts = rows.groupBy(by, category).agg(F.count("*").cast("double").alias("_n"))
    total = counts.groupBy(by).agg(F.sum("_n").alias("_t"))
    p = F.col("_n") / F.col("_t")
    return counts.join(total, by).groupBy(by).agg((-F.sum(p * F.log(p))).alias("diversity"))


def purity(rows: DataFrame, label: str, cluster: str) -> DataFrame:
    """One row: the share of rows that have their cluster's commonest label."""
    counts = rows.groupBy(cluster, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(cluster).agg(F.max("_n").alias("_m"), F.sum("_n").alias("_t")).agg((F.sum("_m").cast("double") / F.sum("_t")).alias("purity"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari of two labellings."""
    pairs = lambda n: n * (n - 1) / 2.0
    both = rows.groupBy(a, b).agg(F.count("*").cast("double").alias("_n"))
    one = lambda c, name: both.groupBy(c).agg(F.sum("_n").alias("_n")).agg(F.sum(pairs(F.col("_n"))).alias(name))
    parts = both.agg(F.sum(pairs(F.col("_n"))).alias("_i"), F.sum("_n").alias("_t")).join(F.broadcast(one(a, "_a"))).join(F.broadcast(one(b, "_b")))
    expected = F.col("_a") * F.col("_b") / pairs(F.col("_t"))
    return parts.select(F.try_divide(F.col("_i") - expected, (F.col("_a") + F.col("_b")) / 2 - expected).alias("ari"))


def overlap_scores(rows: DataFrame, ref: str, query: str, cluster: str) -> DataFrame:
    """(ref, query, score): sum over clusters of the smaller of both labels' shares."""
    share = lambda c: (lambda d: d.join(d.groupBy(c).agg(F.sum("_n").alias("_t")), c).select(c, cluster, (F.col("_n") / F.col("_t")).alias(f"_p{c}")))(rows.where(F.col(c).isNotNull()).groupBy(c, cluster).agg(F.count("*").cast("double").alias("_n")))
    return share(ref).join(share(query), cluster).groupBy(ref, query).agg(F.sum(F.least(f"_p{ref}", f"_p{query}")).alias("score"))


def pairwise(x: DataFrame, other: DataFrame | None = None, term: Callable[[Column, Column], Column] = lambda a, b: (a - b) * (a - b), combine: Callable[[Column], Column] = F.sum, finish: Callable[[Column], Column] = F.sqrt, row: str = "row", column: str = "column") -> DataFrame:
    """(i, j, value) of dense rows by any distance: finish(combine(term(a, b) over the columns)); Euclidean by default."""
    side = lambda d, key, name: d.select(F.col(row).alias(key), column, F.col("value").cast("double").alias(name))
    met = side(x, "i", "_a").join(side(other if other is not None else x, "j", "_b"), column)
    return met.groupBy("i", "j").agg(combine(term(F.col("_a"), F.col("_b"))).alias("_v")).select("i", "j", finish(F.col("_v")).alias("value"))


def chebyshev(x: DataFrame, other: DataFrame | None = None, row: str = "row", column: str = "column") -> DataFrame:
    """(i, j, value) of dense rows by their largest absolute difference: pairwise() without a row per pair and column."""
    return largest_difference(x, other if other is not None else x, row, column)


def mask_or(*masks: DataFrame, key: str = "feature_id") -> DataFrame:
    """(key, selected): whether any of the masks (key, selected) holds; null counts as false."""
    rows = functools.reduce(DataFrame.unionByName, (m.select(key, "selected") for m in masks))
    return rows.groupBy(key).agg(F.coalesce(F.bool_or("selected"), F.lit(False)).alias("selected"))


def diagonal_score(scores: DataFrame, ref_groups: DataFrame, query_groups: DataFrame) -> DataFrame:
    """One row: the sum of the mean scores of equal groups over that of different ones.

    scores are (ref, query, score), absent pairs 0; the groups are (ref, ref_group) and (query, query_group).
    """
    sums = scores.join(ref_groups, "ref").join(query_groups, "query").groupBy("ref_group", "query_group").agg(F.sum("score").alias("_s"))
    size = lambda d, by: d.groupBy(by).agg(F.count("*").cast("double").alias(f"_n_{by}"))
    mean = F.col("_s") / (F.col("_n_ref_group") * F.col("_n_query_group"))
    same = F.col("ref_group") == F.col("query_group")
    blocks = sums.join(size(ref_groups, "ref_group"), "ref_group").join(size(query_groups, "query_group"), "query_group")
    return blocks.agg(F.try_divide(F.sum(F.when(same, mean).otherwise(0.0)), F.sum(F.when(~same, mean).otherwise(0.0))).alias("score"))


def quality_density(cells: DataFrame, least: int = 500, per_decade: int = 10, per_unit: int = 2) -> DataFrame:
    """(size_bin, tsse_bin, n): cells (n_fragment, tsse) on a grid of log10 n_fragment and tsse."""
    at = lambda c, k: F.floor(F.round(c, 6) * k).cast("long")
    return cells.where(F.col("n_fragment") >= least).groupBy(at(F.log10("n_fragment"), per_decade).alias("size_bin"), at(F.col("tsse"), per_unit).alias("tsse_bin")).agg(F.count("*").alias("n"))


def region_heat_map(x: DataFrame, groups: DataFrame, sizes: DataFrame, features: DataFrame | None = None, cell: str = "barcode", feature: str = "feature_id") -> DataFrame:
    """(group, feature, value): log2(1 + RPKM), of the chosen features if any are given; RPKM is over all of them."""
    from fraglens.operators.matrix import aggregate_x

    rpkm = aggregate_x(x, groups, "RPKM", sizes, cell, feature)
    if features is not None:
        rpkm = rpkm.join(features.select(feature).distinct(), feature, "left_semi")
    return rpkm.select("group", feature, F.log2(1 + F.col("value")).alias("value"))
