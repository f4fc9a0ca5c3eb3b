"""Motif scores on sequences, and enrichment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglens.functions.tails import binomial_cdf, binomial_sf, hypergeometric_cdf, hypergeometric_sf
from fraglens.operators.stats import adjust_bh

#: Width of a score bin of the null distribution, and its bins at most.
PRECISION, MOST_BINS = 1e-3, 200_000
_CODE = np.full(256, 4, dtype=np.int64)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


@dataclass(frozen=True)
class Motif:
    """pwm: a row of four probabilities (A, C, G, T) for each position; zeros become 1e-4 and rows sum to 1."""

    id: str
    pwm: tuple[tuple[float, float, float, float], ...]
    name: str | None = None
    family: str | None = None

    def matrix(self) -> np.ndarray:
        m = np.asarray(self.pwm, dtype=float)
        m = np.where(m == 0, 1e-4, m)
        return m / m.sum(axis=1, keepdims=True)

    def information(self) -> float:
        """Sum over positions of 2 + sum p log2 p."""
        m = self.matrix()
        return float((2 + (m * np.log2(m)).sum(axis=1)).sum())

    def log_odds(self, background: Sequence[float] = (0.25,) * 4) -> np.ndarray:
        """Scores by position and letter; any other letter scores 0."""
        return np.hstack([np.log(self.matrix() / np.asarray(background)), np.zeros((len(self.pwm), 1))])


@lru_cache(maxsize=4096)
def threshold(motif: Motif, p_value: float = 1e-5, background: tuple[float, ...] = (0.25,) * 4) -> float:
    """The least score whose upper tail under the background is at most p_value, by convolution over positions."""
    s = motif.log_odds(background)[:, :4]
    low, high = s.min(axis=1), s.max(axis=1)
    step = max(PRECISION, float((high - low).sum()) / MOST_BINS)
    dist = np.ones(1)
    for row, least in zip(s, low, strict=True):
        at = np.rint((row - least) / step).astype(int)
        new = np.zeros(len(dist) + at.max())
        for k, p in zip(at, background, strict=True):
            new[k : k + len(dist)] += p * dist
        dist = new
    tail = np.cumsum(dist[::-1])[::-1]
    ok = np.flatnonzero(tail <= p_value)
    return float(low.sum() + (ok[0] if len(ok) else len(tail)) * step)


def scores(motif: Motif, sequence: str, background: tuple[float, ...] = (0.25,) * 4) -> np.ndarray:
    """The score at each start."""
    s, code = motif.log_odds(background), _CODE[np.frombuffer(sequence.encode("latin-1", "replace"), dtype=np.uint8)]
    n = len(code) - len(s) + 1
    return sum((s[k][code[k : k + n]] for k in range(len(s))), np.zeros(n)) if n > 0 else np.zeros(0)


def reverse_complement(sequence: str) -> str:
    return sequence[::-1].translate(str.maketrans("ACGTacgt", "TGCATGCA"))


def scan(sequences: DataFrame, motifs: list[Motif], p_value: float = 1e-5, both_strands: bool = True) -> DataFrame:
    """(region_id, motif_id) for each motif that hits a sequence (region_id, seq). The list of motifs goes to every task."""
    limits = [(m, threshold(m, p_value)) for m in motifs]
    kind = dict(sequences.dtypes)["region_id"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            names, seqs = pdf["region_id"].to_numpy(), [x or "" for x in pdf["seq"]]
            hit = np.zeros((len(names), len(limits)), dtype=bool)
            owner = np.repeat(np.arange(len(seqs)), [len(x) for x in seqs])
            joined = "".join(seqs)  # all of a batch at once; starts whose motif reaches into the next sequence don't count
            for text, of in ((joined, owner), (reverse_complement(joined), owner[::-1]))[: 1 + both_strands]:
                for k, (m, limit) in enumerate(limits):
                    value = scores(m, text)
                    at = np.flatnonzero(value >= limit)
                    hit[of[at][of[at] == of[at + len(m.pwm) - 1]], k] = True
            i, k = np.nonzero(hit)
            yield pd.DataFrame({"region_id": names[i], "motif_id": [limits[x][0].id for x in k]})

    return sequences.select("region_id", "seq").mapInPandas(run, f"region_id {kind}, motif_id string")


def enrichment(hits: DataFrame, groups: DataFrame, background: DataFrame, method: str = "binomial", strict: bool = False) -> DataFrame:
    """(group, motif_id, log2_fc, p_value, q_value) of hits (region_id, motif_id) in regions (group, region_id) against background regions.

    Upper tail (at least as many; more, if strict) where the fold change is at least 1, else the lower one.
    """
    total = groups.groupBy("group").agg(F.countDistinct("region_id").alias("n"))
    size = background.agg(F.countDistinct("region_id").alias("bg_n"))
    inside = groups.join(hits, "region_id").groupBy("group", "motif_id").agg(F.countDistinct("region_id").alias("k"))
    outside = hits.join(background.select("region_id").distinct(), "region_id", "left_semi").groupBy("motif_id").agg(F.countDistinct("region_id").alias("bg_k"))
    counts = total.crossJoin(F.broadcast(outside)).join(inside, ["group", "motif_id"], "left").join(F.broadcast(size)).fillna(0, ["k"])
    kind = dict(groups.dtypes)["group"]

    def test(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for g, m, n, bk, k, bn in pdf[["group", "motif_id", "n", "bg_k", "k", "bg_n"]].itertuples(index=False):
                fc = float(np.log2(((k + 1) / (n + 1)) / ((bk + 1) / (bn + 1))))
                if method == "hypergeometric":
                    p = hypergeometric_sf(k - (not strict), bn, bk, n) if fc >= 0 else hypergeometric_cdf(k, bn, bk, n)
                else:
                    rate = bk / bn if bn else 0.0
                    p = binomial_sf(k - (not strict), n, rate) if fc >= 0 else binomial_cdf(k, n, rate)
                rows.append((g, m, fc, max(p, 1e-300)))
            yield pd.DataFrame(rows, columns=["group", "motif_id", "log2_fc", "p_value"])

    return adjust_bh(counts.mapInPandas(test, f"group {kind}, motif_id string, log2_fc double, p_value double"), by=["group"], tie="motif_id")


def heat_map(enriched: DataFrame, min_fc: float = 1.0, max_fdr: float = 0.01) -> DataFrame:
    """Motifs with a large change and a small q in some group; value is sign * ln(1 - log10 p)."""
    good = enriched.groupBy("motif_id").agg(F.max(F.abs("log2_fc")).alias("fc"), F.min("q_value").alias("q")).where((F.col("fc") >= min_fc) & (F.col("q") <= max_fdr)).select("motif_id")
    return enriched.join(good, "motif_id", "left_semi").select("group", "motif_id", (F.signum("log2_fc") * F.log(1 - F.log10("p_value"))).alias("value"))
