"""Packing token sequences by patterns fitted with non-negative least squares.

Documents become pieces of at most `capacity` tokens. Patterns are sets of one to three lengths that fill a
sequence exactly; repeat counts x >= 0 minimise |A x - h| against the histogram h of lengths, are rounded, and
what they leave over is packed best-fit, longest first, on the histogram. Only the histogram (at most `capacity`
numbers) reaches the driver; pieces find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraglens.llm.common import materialise, slim, tune

CAPACITY = 1024
END_ID = 2
MEMO_WORDS, MEMO_CHARS, LEARNT_AT_ONCE = 300_000, 64, 20_000
#: White space after a space: there the pre-tokenizer's runs may cross the space.
_RUN = re.compile(r" \s")
#: Words that the fast path takes: Latin characters, nothing that could be a special token, line breaks inside only.
_EASY = re.compile(r"[!-;=-~\u00a1-\u024f]+(?:[\t\n\r]+[!-;=-~\u00a1-\u024f]+)*")


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, which keeps what it has learnt from task to task."""
    return WordTokenizer(path)


class WordTokenizer:
    """A byte-level vocabulary applied word by word: its pre-tokenizer never joins a word with the space after it.

    Words are encoded once and remembered. Plain ones are merged by tiktoken from the vocabulary's ranks, which gives the
    library's ids (a test compares them); the rest goes to the library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            vocab = json.load(f)["model"]["vocab"]
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        spelt = {s: b for c in map(chr, [*range(0x800), *range(0x800, 0x110000, 0x800)]) if not 0xD800 <= ord(c) < 0xE000 for b, s in zip(c.encode(), spell.pre_tokenize_str(c)[0][0], strict=True)}
        ranks = {bytes(map(spelt.__getitem__, t)): i for t, i in vocab.items() if spelt.keys() >= set(t)}
        self.merge = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)  # ids that begin with a space
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode words, each after a space, and remember them."""
        easy = [w for w in words if _EASY.fullmatch(w)]
        for at in range(0, len(easy), LEARNT_AT_ONCE):
            some = easy[at : at + LEARNT_AT_ONCE]
            ids = np.array(self.merge(" " + " ".join(some)), dtype="<u4")
            cuts = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            self.words.update(zip(some, [raw[i:k] for i, k in zip(cuts, cuts[1:])], strict=True))
        for w in words.difference(easy):
            self.words[w] = self.whole(f" {w}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plain = [t.split(" ") if not _RUN.search(t) else None for t in texts]
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        unseen = set().union(*(p[1:] for p in plain if p)) - self.words.keys()
        self.learn(unseen)
        get = self.words.__getitem__
        out = [self._mixed(t) if p is None else (self.whole(p[0]) if p[0] else b"") + b"".join(map(get, p[1:])) for t, p in zip(texts, plain, strict=True)]
        for w in [w for w in unseen if len(w) > MEMO_CHARS]:
            self.words.pop(w, None)
        return out

    def _mixed(self, text: str) -> bytes:
        """A text with runs of white space: cut before single spaces between other characters."""
        cuts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
        return b"".join(self.whole(text[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a)


_CUT = re.compile(r"(?<=\S) (?=\S)")


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths (0: none) that sum to capacity, of lengths that are present."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[present] = True
    rows = [(capacity, 0, 0)] if have[capacity] else []
    rows += [(capacity - a, a, 0) for a in range(1, capacity // 2 + 1) if have[a] and have[capacity - a]]
    for a in (x for x in range(1, capacity // 3 + 1) if have[x]):
        b = np.arange(a, (capacity - a) // 2 + 1)
        b = b[have[b] & have[capacity - a - b]]
        rows += [(capacity - a - int(x), int(x), a) for x in b]
    return np.asarray(rows, dtype=np.int64).reshape(-1, 3)


def fit_counts(pats: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with the least |A x - h|, by accelerated projected gradients."""
    if not len(pats):
        return np.zeros(0)
    n = len(histogram)
    h = histogram.astype(float)
    h[0] = 0
    used = pats > 0

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(pats[:, k], weights=x * used[:, k], minlength=n) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return (r[pats] * used).sum(axis=1)

    v = np.ones(len(pats))
    for _ in range(20):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - h) / (1.05 * norm))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) for a histogram h[length]; every piece is used once."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    pats = patterns(np.flatnonzero(left), capacity)
    x = fit_counts(pats, left)
    for k in np.argsort(-x, kind="stable"):
        want = int(np.floor(x[k] + 0.5))
        if not want:
            break
        row = tuple(int(v) for v in pats[k] if v)
        n = min(want, min(int(left[v]) // row.count(v) for v in row))
        if n > 0:
            out.append((row, n))
            for v in row:
                left[v] -= n
    return out + best_fit(left)


def best_fit(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the fullest sequence with room, many equal pieces at once."""
    capacity = len(histogram) - 1
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []  # sorted rooms that have open sequences
    done: list[tuple[tuple[int, ...], int]] = []

    def put(row: tuple[int, ...], room: int, n: int) -> None:
        if not room:
            done.append((row, n))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([row, n])

    for length in range(capacity, 0, -1):
        n = int(histogram[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fits = capacity // length
                if n >= fits and fits > 1:
                    put((length,) * fits, capacity - fits * length, n // fits)
                    n %= fits
                else:
                    put((length,) * n if fits > 1 else (length,), capacity - length * (n if fits > 1 else 1), 1 if fits > 1 else n)
                    n = 0
                continue
            room = rooms[at]
            held = open_[room]
            row, have = held[-1]
            k = min(n, have)
            if k == have:
                held.pop()
                if not held:
                    del open_[room]
                    rooms.pop(at)
            else:
                held[-1][1] -= k
            put((*row, length), room - length, k)
            n -= k
    return done + [(row, n) for held in open_.values() for row, n in held]


def places(chosen: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted (length * 2^40 + first rank), first sequence and offset of each run of equal places."""
    rank = np.zeros(capacity + 1, dtype=np.int64)
    keys, firsts, offsets = [], [], []
    sequence = 0
    for row, n in chosen:
        offset = 0
        for v in row:
            keys.append((v << 40) + int(rank[v]))
            firsts.append(sequence)
            offsets.append(offset)
            rank[v] += n
            offset += v
        sequence += n
    order = np.argsort(np.asarray(keys, dtype=np.int64), kind="stable")
    return tuple(np.asarray(x, dtype=np.int64)[order] for x in (keys, firsts, offsets))


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, and part and rank of the row."""
    tune(docs.sparkSession)

    def run(batches):
        coder, part = word_tokenizer(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            cols: list[list[int]] = [[], [], [], [], [], []]
            names = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, raw in zip(batch.column(0).to_pylist(), coder.encode(texts), strict=True):
                raw = memoryview(raw + end)
                n = len(raw) // 4
                at, k = 0, 0
                while at < n:
                    size = min(capacity, n) if k else (n % capacity or capacity)
                    for c, v in zip(cols, (k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), part, seen[size]), strict=True):
                        c.append(v)
                    names.append(doc_id)
                    seen[size] += 1
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select("doc_id", "text").mapInArrow(slim(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text).

    A null or empty text is one piece with the end id alone. Longer documents are cut so that the first piece is
    the shorter one. Repeated rows and ids are packed once each; an empty table gives an empty result.
    """
    pieces = materialise(cut_documents(docs, tokenizer, capacity))
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r.length] = r.n
    keys, firsts, offsets = places(plan(histogram), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offset = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    shared = docs.sparkSession.sparkContext.broadcast((keys, firsts, offsets))

    def locate(batches):
        keys, firsts, offsets = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            want = (length << 40) + rank
            at = np.searchsorted(keys, want, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(firsts[at] + want - keys[at], pa.int64()), pa.array(offsets[at], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(offset, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(slim(locate), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
