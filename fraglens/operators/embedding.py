"""Spectral embedding of cells from a count matrix (cell, feature_id, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglens.operators.matrix import idf, tf_idf
from fraglens.operators.stats import cosine, jaccard
from fraglens.operators.steps import cut

#: Cells whose similarities are decomposed on the driver; the others are projected.
LANDMARKS = 4000


def _dense(rows: pd.DataFrame, cells: dict, features: dict) -> np.ndarray:
    out = np.zeros((len(cells), len(features)))
    out[rows["barcode"].map(cells).to_numpy(), rows["feature_id"].map(features).to_numpy()] = rows["value"].to_numpy()
    return out


def scaled_eigen(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest eigenpairs of D^-1/2 (S - I) D^-1/2, S similarities with a unit diagonal, and D's diagonal."""
    degree = np.maximum(s.sum(axis=1) - 1, 1e-12)
    a = (s - np.eye(len(s))) / np.sqrt(degree[:, None] * degree)
    w, u = np.linalg.eigh(a)
    order = np.argsort(-w)[:k]
    u = u[:, order]
    return w[order], u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1, 1), degree


def spectral(x: DataFrame, n_comps: int = 30, landmarks: int = LANDMARKS, weighted: bool = True, variant: str = "log") -> tuple[DataFrame, np.ndarray]:
    """(barcode, v) and eigenvalues: cosine similarities of idf-weighted cells, normalised by degree.

    Up to `landmarks` cells (those with the smallest hashes) are decomposed exactly; the rest are projected on the
    landmarks' eigenvectors (Nystrom), with sums over all landmarks, so that results don't depend on partitions.
    With `weighted`, components with positive eigenvalues are multiplied by their square roots.
    """
    x = cut(x)
    unit = cut(tf_idf(x, idf(x, variant)).where("value <> 0"))
    chosen = unit.select("barcode").distinct().orderBy(F.xxhash64("barcode"), "barcode").limit(landmarks)
    local = unit.join(F.broadcast(chosen), "barcode").toPandas()
    cells = {c: i for i, c in enumerate(sorted(local["barcode"].unique()))}
    features = {f: i for i, f in enumerate(sorted(local["feature_id"].unique()))}
    m = _dense(local, cells, features)
    values, vectors, degree = scaled_eigen(m @ m.T, min(n_comps, len(cells)))
    keep = values > 0 if weighted else np.abs(values) > 1e-12
    values, vectors = values[keep], vectors[:, keep]
    factor = m.T @ (vectors / np.sqrt(degree)[:, None])  # features x components
    scale = np.sqrt(values) if weighted else np.ones(len(values))
    column_sum = m.sum(axis=0)

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["barcode"].iloc[0]
        if name in cells:
            v = vectors[cells[name]]
        else:
            at = pdf["feature_id"].map(features)
            have = at.notna().to_numpy()
            idx, val = at[have].astype(int).to_numpy(), pdf["value"].to_numpy()[have]
            d = max(float(val @ column_sum[idx]), 1e-12)
            v = (val @ factor[idx]) / np.sqrt(d) / values
        return pd.DataFrame({"barcode": [name], "v": [(v * scale).tolist()]})

    return unit.groupBy("barcode").applyInPandas(project, "barcode string, v array<double>"), values


def multi_spectral(views: list[DataFrame], weights: list[float] | None = None, n_comps: int = 30, landmarks: int = LANDMARKS) -> tuple[DataFrame, np.ndarray]:
    """Embedding of cells seen in several matrices: each is normalised, weighted by its similarity norm, and joined."""
    parts = []
    for k, view in enumerate(views):
        view = cut(view)
        unit = cut(tf_idf(view, idf(view)).where("value <> 0"))
        chosen = unit.select("barcode").distinct().orderBy(F.xxhash64("barcode"), "barcode").limit(min(landmarks, 2000))
        local = unit.join(F.broadcast(chosen), "barcode").toPandas()
        cells = {c: i for i, c in enumerate(sorted(local["barcode"].unique()))}
        m = _dense(local, cells, {f: i for i, f in enumerate(sorted(local["feature_id"].unique()))})
        norm = np.sqrt(max(1e-12, ((m @ m.T) ** 2).sum() - len(cells)))
        w = (weights[k] if weights else 1.0) / norm
        parts.append((unit, w, k))
    total = sum(w for _, w, _ in parts)
    joined = None
    for unit, w, k in parts:
        part = unit.select("barcode", (F.col("feature_id") * len(views) + k).alias("feature_id"), (F.col("value") * float(np.sqrt(w / total))).alias("value"))
        joined = part if joined is None else joined.unionByName(part)
    return spectral(joined, n_comps, landmarks, variant="log")


def layout(points: DataFrame, n_comps: int = 2) -> DataFrame:
    """(id, v): a plain linear layout by principal components of points (id, v array<double>)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = points.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("f"))
    return PCA(k=n_comps, inputCol="f", outputCol="o").fit(data).transform(data).select("id", vector_to_array("o").alias("v"))


def dense_spectral(x: DataFrame, n_comps: int = 30, metric: str = "jaccard", most: int = LANDMARKS, gamma: float | None = None) -> tuple[DataFrame, np.ndarray]:
    """(barcode, v) and eigenvalues of the whole similarity matrix of up to `most` cells; more raise ValueError.

    Jaccard similarities are divided by what a linear fit expects of the cells' shares of present features, and cut at
    their 0.999 quantile. rbf is exp(-gamma * squared distance), gamma one over the number of features by default.
    """
    x = cut(x.where("value <> 0"))
    shares = x.groupBy("barcode").agg(F.countDistinct("feature_id").alias("n")).orderBy("barcode").limit(most + 1).toPandas()
    if len(shares) > most:
        raise ValueError(f"over {most} cells: use spectral")
    at = {c: i for i, c in enumerate(shares["barcode"])}
    features = x.select("feature_id").distinct().count()
    long = x.select(F.col("barcode").alias("row"), F.col("feature_id").alias("column"), F.col("value").cast("double").alias("value"))
    if metric == "rbf":
        met = long.join(long.toDF("j", "column", "b"), "column").groupBy(F.col("row").alias("i"), "j").agg(F.sum(F.col("value") * F.col("b")).alias("value"))
    else:
        met = {"jaccard": jaccard, "cosine": cosine}[metric](long)
    pdf = met.toPandas()
    s = np.zeros((len(at), len(at)))
    s[pdf["i"].map(at), pdf["j"].map(at)] = pdf["value"]
    if metric == "rbf":
        norm = np.diag(s)
        s = np.exp(-(1 / features if gamma is None else gamma) * np.maximum(0, norm[:, None] + norm - 2 * s))
    elif metric == "jaccard":
        share = shares["n"].to_numpy() / features
        chance = 1 / (1 / share[:, None] + 1 / share - 1)
        off = ~np.eye(len(at), dtype=bool)
        if off.any() and np.ptp(chance[off]) > 0:
            slope, base = np.polyfit(chance[off], s[off], 1)
        else:
            slope, base = 0.0, 1.0
        s = s / np.maximum(slope * chance + base, 1e-12)
        s = np.clip(s, 0, np.quantile(s[off], 0.999) if off.any() else 1)
    np.fill_diagonal(s, 1)
    values, vectors, _ = scaled_eigen(s, min(n_comps, len(at)))
    rows = [(c, vectors[i].tolist()) for c, i in at.items()]
    return x.sparkSession.createDataFrame(rows, "barcode string, v array<double>"), values


def unit_components(points: DataFrame, n_comps: int = 2) -> DataFrame:
    """(id, v): centred principal component scores of points (id, v) divided by their singular values; 0 without spread."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    data = cut(points.select("id", F.col("v").cast("array<double>").alias("v"))).select("id", array_to_vector("v").alias("f"))
    mean = data.agg(Summarizer.mean(F.col("f")).alias("m")).first()["m"]
    model = PCA(k=n_comps, inputCol="f", outputCol="o").fit(data)
    shift = [float(v) for v in model.pc.toArray().T @ mean.toArray()]
    scores = model.transform(data).select("id", F.zip_with(vector_to_array("o"), F.array(*map(F.lit, shift)), lambda a, b: a - b).alias("v"))
    size = scores.agg(*(F.sqrt(F.sum(F.col("v")[k] * F.col("v")[k])).alias(f"s{k}") for k in range(n_comps)))
    return scores.join(F.broadcast(size)).select("id", F.array(*(F.coalesce(F.try_divide(F.col("v")[k], F.col(f"s{k}")), F.lit(0.0)) for k in range(n_comps))).alias("v"))


def truncated_svd(x: DataFrame, n_comps: int = 30, landmarks: int = LANDMARKS) -> tuple[DataFrame, np.ndarray]:
    """(feature_id, v) loadings and singular values of the matrix (barcode, feature_id, value), fitted on up to `landmarks` cells."""
    chosen = x.select("barcode").distinct().orderBy(F.xxhash64("barcode"), "barcode").limit(landmarks)
    local = x.join(F.broadcast(chosen), "barcode").toPandas()
    features = sorted(local["feature_id"].unique())
    m = _dense(local, {c: i for i, c in enumerate(sorted(local["barcode"].unique()))}, {f: i for i, f in enumerate(features)})
    _, values, vt = np.linalg.svd(m, full_matrices=False)
    vt, values = vt[:n_comps], values[:n_comps]
    vt = vt * np.where(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)] < 0, -1, 1)[:, None]
    table = pd.DataFrame({"feature_id": features, "v": vt.T.tolist()})
    return x.sparkSession.createDataFrame(table, f"feature_id {dict(x.dtypes)['feature_id']}, v array<double>"), values


def project(x: DataFrame, loadings: DataFrame, n_comps: int) -> DataFrame:
    """(barcode, v): cells of the matrix on the loadings (feature_id, v); features without loadings count as 0."""
    met = x.join(loadings, "feature_id")
    return met.groupBy("barcode").agg(F.array(*(F.sum(F.col("value") * F.col("v")[k]) for k in range(n_comps))).alias("v"))


def lsi(x: DataFrame, n_comps: int = 30, landmarks: int = LANDMARKS) -> tuple[DataFrame, np.ndarray]:
    """(barcode, v) and singular values of the tf-idf matrix."""
    unit = cut(tf_idf(x, idf(x, "lsi")).where("value <> 0").select("barcode", "feature_id", "value"))
    loadings, values = truncated_svd(unit, n_comps, landmarks)
    return project(unit, loadings, len(values)), values
