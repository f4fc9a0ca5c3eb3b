"""Quality by weak labels.

Overlapping heuristics vote good, bad or nothing on each document. Expectation-maximisation over the counts of all
vote patterns estimates how each heuristic votes on good and on bad documents; the posterior of a document's pattern is
its weak label. A linear scorer on hashed word shapes is trained on the weak labels of a bounded sample.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglens.llm.common import columns_of, fields, slim, tune, with_row

#: Documents that the scorer is trained on (those with the smallest hashes), and hashed features.
SAMPLE, FEATURES = 6000, 1 << 14
MEMO_WORDS, MEMO_CHARS = 300_000, 64
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_SIGNS = b"%&$#*!|~^=_<>{}[]\\"
_SPACES = b" \t\n\r\x0b\x0c"
GOOD, BAD = 1, 2
#: Chance of a good and of a bad vote of a heuristic: on good documents, on bad ones; where learning starts.
START = ((0.9, 0.0002), (0.75, 0.2))
START_BAD = 0.15
#: A good document draws a bad vote from a heuristic at most this often; else the commonest fault would pass as good.
FALSE_BAD = 0.0002
#: Weight of the start, in documents.
PRIOR_DOCS = 20.0


def votes(text: str) -> tuple[int, ...]:
    """What each heuristic says of a text: 1 good, 2 bad, 0 nothing."""
    raw, words = text.encode(), text.split()
    n = len(words)
    if not n:
        return (BAD,) * 7
    solid = len(raw.translate(None, _SPACES))
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    digits = len(raw) - len(raw.translate(None, _DIGITS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    signs = len(raw) - len(raw.translate(None, _SIGNS))
    again = sum(map(eq, words, islice(words, 1, None))) / n
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0

    def judge(x: float, good: float, bad: float) -> int:
        return GOOD if x <= good else BAD if x >= bad else 0

    return (
        judge(words.count("|") / n, 0.001, 0.05),
        judge(upper / max(1, letters), 0.2, 0.6),
        judge(signs / max(1, solid), 0.03, 0.06),
        judge(again, 0.05, 0.3),
        judge(1 - (letters + digits) / max(1, solid), 0.25, 0.6),
        judge(repeated, 0.2, 0.6),
        judge(abs(solid / n - 5.5), 4.0, 12.0),
    )


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """(chances[class, labeller, vote], share of bad ones, posterior that each pattern is good).

    patterns: votes by row, counts: documents with them. The start counts as PRIOR_DOCS documents, so that a heuristic
    that never votes, or a table without bad documents, leaves the estimates defined.
    """
    start = np.array([[[1 - g - b, g, b]] * patterns.shape[1] for g, b in START])
    if not len(patterns):
        return start, START_BAD, np.zeros(0)
    chance, bad = start.copy(), START_BAD
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        logs = np.log([1 - bad, bad])[:, None] + np.array([[np.log(chance[c, np.arange(patterns.shape[1]), p]).sum() for p in patterns] for c in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -60, 60)))
        weight = np.stack([new, 1 - new]) * counts
        for v in range(3):
            chance[:, :, v] = weight @ (patterns == v) + PRIOR_DOCS * start[:, :, v]
        chance /= chance.sum(axis=2, keepdims=True)
        chance[0, :, BAD] = np.minimum(chance[0, :, BAD], FALSE_BAD)
        chance[0, :, GOOD] = 1 - chance[0, :, 0] - chance[0, :, BAD]
        bad = float((weight[1].sum() + PRIOR_DOCS * START_BAD) / (counts.sum() + PRIOR_DOCS))
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    return chance, bad, posterior


_SHAPES = ((re.compile(r"[^\W\d_]+"), lambda m: ("A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a") + ("+" if len(m[0]) > 14 else "")), (re.compile(r"[0-9]+"), lambda m: "0"), (re.compile(r"([^\w\s])\1+"), lambda m: m[1] * 2))


def shape(word: str) -> str:
    """Letters as a, Aa or A, numbers as 0, repeated signs twice."""
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return word


class _Features(dict):
    """Words to their hashed features."""

    def __missing__(self, word: str) -> int:
        found = zlib.crc32(shape(word).encode()) % (FEATURES - 1) + 1
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = found
        return found


def features(text: str, memo: _Features) -> np.ndarray:
    """The hashed feature of each word; feature 0 for a word that repeats the one before."""
    words = text.split()
    got = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
    again = np.fromiter(map(eq, words, islice(words, 1, None)), dtype=bool, count=max(0, len(words) - 1))
    if again.any():
        got[1:][again] = 0
    return got


def train(rows: list[np.ndarray], counts: list[np.ndarray], target: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a penalised logistic model on shares of features, by Adam on the whole sample.

    rows: the distinct features of each document, counts: how often each occurs in it.
    """
    w, b = np.zeros(FEATURES), 0.0
    if not len(rows):
        return w, 0.0
    size = np.array([c.sum() for c in counts])
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col, count = np.concatenate(rows).astype(np.int64), np.concatenate(counts)
    value = np.sqrt(count / size[doc])
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(doc, weights=value * w[col], minlength=len(rows)) + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g = np.bincount(col, weights=value * r[doc], minlength=FEATURES) + 1e-5 * w
        gb = r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


OUTPUT = ["quality_posterior", "quality_score", "quality_kept"]


def score_quality(docs: DataFrame, only_kept: bool = False) -> DataFrame:
    """docs (with text) and quality_posterior, quality_score (0 to 1, higher is better) and quality_kept.

    With only_kept the columns are those of docs and the rows those that are kept.

    Vote patterns are counted over all documents; the scorer is trained on at most SAMPLE of them, chosen by a hash of
    the text. A document is kept if its score is at least 0.5. A null text, or one without words, has score 0 and
    isn't kept. Equal texts have equal scores; texts are read whole, however long; extra columns are kept, whatever their
    names, but those named like the three results give way to them; an empty table gives an empty result.
    """
    tune(docs.sparkSession)

    def count(batches):
        seen: dict[tuple[int, ...], int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                k = votes(t or "")
                seen[k] = seen.get(k, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    tally = docs.select("text").mapInArrow(slim(count), "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()  # at most 3^7 rows
    patterns = np.array([r.votes for r in tally], dtype=np.int64).reshape(len(tally), 7)
    _, _, posterior = estimate(patterns, np.array([r.n for r in tally], dtype=float))
    belief = {tuple(r.votes): float(p) for r, p in zip(tally, posterior, strict=True)}
    # hashes are ordered without their texts; equal texts count once
    hashed = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text")
    most = hashed.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(most).cast("long")).groupBy("h").agg(F.first("text").alias("text")).select("text")

    def shapes(batches):
        memo = _Features()
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t.split()]
            pairs = [np.unique(features(t, memo), return_counts=True) for t in texts]
            f, n = pa.array([f.astype(np.int16) for f, _ in pairs], pa.list_(pa.int16())), pa.array([n.astype(np.int32) for _, n in pairs], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([f, n, pa.array([belief[votes(t)] for t in texts], pa.float64())], ["f", "n", "y"])

    sample = chosen.mapInArrow(slim(shapes), "f array<smallint>, n array<int>, y double").toArrow()  # at most FEATURES pairs a document
    w, bias = train(list(sample.column("f").to_numpy()), list(sample.column("n").to_numpy()), sample.column("y").to_numpy())
    def run(batches):
        memo = _Features()
        for b in batches:
            scores, beliefs = [], []
            for t in b.column("text").to_pylist():
                f = features(t or "", memo)
                beliefs.append(belief[votes(t or "")])
                if not len(f):
                    scores.append(0.0)
                    continue
                n = np.bincount(f, minlength=FEATURES)
                at = np.flatnonzero(n)
                z = float(np.sqrt(n[at] / len(f)) @ w[at]) + bias
                scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(beliefs, pa.float64()), pa.array(scores, pa.float64())], ["row", "text", "p", "s"])

    kept = [c for c in docs.columns if only_kept or c not in OUTPUT]
    framed = docs.select(F.struct(F.lit(0).alias("_"), *columns_of(docs, ["text", *(() if only_kept else OUTPUT)])).alias("row"), "text")
    done = framed.mapInArrow(slim(run), with_row(framed, "text string, p double, s double"))
    if only_kept:
        return done.where("s >= 0.5").select(*fields(kept))
    return done.select(*fields(kept), F.col("p").alias("quality_posterior"), F.col("s").alias("quality_score"), (F.col("s") >= 0.5).alias("quality_kept"))
