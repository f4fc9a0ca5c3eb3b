"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits and signs that stand for letters), and the lexicon's stems and
words, and exception phrases around them, are found by an Aho-Corasick automaton. The sum of weights, normalised by
length, goes through a logistic curve. Lexicon, exceptions and curve are learnt from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglens.llm.common import materialise, tune

#: Labelled rows that are learnt from (those with the smallest hashes), and entries of the lexicon.
SAMPLE, ENTRIES, PHRASES = 12_000, 600, 200
#: Lengths of stems; shorter words count whole.
STEMS = (4, 5, 6, 7)
# Letters that look like Latin ones.
_LOOKALIKE = str.maketrans({"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ⅼ": "l", "ı": "i", "ɑ": "a"})
# What digits and signs stand for inside words; l, 1 and i are one letter.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
_ODD = re.compile("[ɐ-Ͱ-ԯԱ-֏ⅰ-ⅿ！-～​-‏­]")
_TABLE = bytearray(range(256))
for _i in range(128):
    _c = chr(_i)
    _TABLE[_i] = ord(_STANDS_FOR.get(_c, _c.lower() if _c.isalpha() else " "))
_TABLE = bytes(_TABLE)
#: Signs that end sentences, before they could stand for letters.
_END = re.compile(r"[!|$@]+(?=\s|$)|(?<!\S)[!|$@]+")


def fold(text: str) -> str:
    """Words of folded letters between single spaces (UTF-8 bytes as characters), a space at both ends."""
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = re.sub("[​-‏­]", "", text)
        text = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in text).translate(_LOOKALIKE)
    if "!" in text or "|" in text or "$" in text or "@" in text:
        text = _END.sub(" ", text)
    return f" {' '.join(text.encode().translate(_TABLE).decode('latin-1').split())} "


def _entries(words: set[str]) -> set[str]:
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    def __init__(self, weights: dict[str, float], phrases: dict[str, float], curve: tuple[float, float] = (0.0, 1.0)):
        import ahocorasick

        self.weights, self.phrases, self.curve = weights, phrases, curve
        self.automaton = ahocorasick.Automaton()
        for entry, w in {**weights, **phrases}.items():
            self.automaton.add_word(entry, (len(entry), w, entry))
        if self.weights:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, entry) of each match."""
        return [(end - size + 1, end + 1, w, entry) for end, (size, w, entry) in self.automaton.iter(folded)] if self.weights else []

    def total(self, folded: str) -> float:
        """Weights of the words that match, the largest of each; words inside an exception phrase count nothing."""
        best: dict[int, float] = {}
        exempt: list[tuple[int, int]] = []
        for start, end, w, entry in self.hits(folded):
            if entry in self.phrases:
                exempt.append((start, end))
            else:
                best[start] = max(w, best.get(start, 0.0))
        return sum(w for at, w in best.items() if not any(a <= at < b for a, b in exempt))

    def measure(self, text: str) -> float:
        folded = fold(text)
        total = self.total(folded)
        return total / math.sqrt(10 + folded.count(" ")) if total else 0.0

    def score(self, text: str) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * self.measure(text)))))


def _counted(batches):
    """Rows in which each entry stands, by label, summed per task."""
    by: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            by[1 if toxic else 0].update(_entries(set(fold(text or "").split())))
    names = list(by[1])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][n] for n in names], pa.int64())], ["entry", "pos"])
    for at in range(0, len(by[0]), 50_000):
        part = list(by[0].items())[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.string()), pa.array([-c for _, c in part], pa.int64())], ["entry", "pos"])


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from the rows of docs that labels (doc_id, toxic) marks; at most SAMPLE of them."""
    wanted = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", "toxic"))  # at most SAMPLE labels
    n = dict(rows.groupBy((F.col("toxic") == 1).alias("t")).count().collect())
    pos, neg = n.get(True, 0), n.get(False, 0)
    if not pos or not neg:
        return Lexicon({}, {}, (math.log((pos + 0.5) / (neg + 0.5)), 0.0))
    counts = rows.mapInArrow(_counted, "entry string, pos long").groupBy("entry").agg(F.sum(F.greatest("pos", F.lit(0))).alias("p"), F.sum(F.greatest(-F.col("pos"), F.lit(0))).alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    support = max(3, round(0.004 * pos))
    best = counts.where(F.col("p") >= support).withColumn("w", odds).where("w > 3").orderBy(F.desc(F.col("p") * F.col("w")), "entry").limit(8 * ENTRIES).collect()
    weights: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (-r.p * r.w, len(r.entry), r.entry)):
        # a stem stands for the words that it begins, where it is hardly seen elsewhere
        if len(weights) < ENTRIES and not any(r.entry.startswith(e) for e in weights if e[-1] != " "):
            weights[r.entry] = float(r.w)

    def around(batches):
        plain = Lexicon(weights, {})
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                folded = fold(text or "")
                found = set()
                for start, end, *_ in plain.hits(folded):
                    stop = folded.find(" ", end - 1)
                    before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
                    found |= {folded[before : stop + 1] if before >= 0 else "", folded[start : after + 1] if after >= 0 else ""}
                seen[1 if toxic else 0].update(found - {""})
        names = list(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], ["phrase", "p", "n"])

    said = rows.mapInArrow(around, "phrase string, p long, n long").groupBy("phrase").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    phrases = {r.phrase: 0.0 for r in said.where((F.col("n") >= 3) & (F.col("n") / neg > 10 * F.col("p") / pos)).orderBy(F.desc("n"), "phrase").limit(PHRASES).collect()}

    def measured(batches):
        full = Lexicon(weights, phrases)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([full.measure(t or "") for t in b.column("text").to_pylist()], pa.float64()), pa.array([float(x) for x in b.column("toxic").to_pylist()])], ["x", "y"])

    points = rows.mapInArrow(measured, "x double, y double").toArrow()  # at most SAMPLE rows
    return Lexicon(weights, phrases, _logistic(points.column("x").to_numpy(), points.column("y").to_numpy()))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the penalised logistic fit."""
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum(), ((y - p) * x).sum()]) - 0.01 * np.array([a, b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + 0.01 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    Rows whose crc32(doc_id as text) is divisible by `folds` are held out; labels are learnt from the others alone.
    Scores depend on the text only. A null or empty text has the score of a text without matches; ties and repeated
    rows have equal scores; without labels of both kinds every row has the same score. A null doc_id isn't held out.
    """
    tune(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    lexicon = learn(docs, labels.select("doc_id", "toxic").where(~held))
    weights, phrases, curve = lexicon.weights, lexicon.phrases, lexicon.curve

    def run(batches):
        own = Lexicon(weights, phrases, curve)
        for b in batches:
            scores = [own.score(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
