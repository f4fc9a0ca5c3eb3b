"""Removal of long repeated strings, judged by suffix arrays over shards.

A window is WIDTH bytes, or a given number of words. Every window has an anchor: the GRAM bytes (ANCHOR_WORDS words) in
it whose hash is smallest (the leftmost of equals). Equal windows have equal anchors at the same place, so the windows
of an anchor, with what they cover, can be judged among themselves. A fragment is the windows of one occurrence.
Anchors that only copies of one text have are never sent: there the whole text repeats. Equal fragments become one row
before they are dealt, and anchors all of whose fragments are equal are settled by their count. The rest are dealt to
shards by anchor; each shard gets a suffix array by induced sorting and its permuted common prefixes, and a window
repeats if it shares its whole length with a neighbour. Anchors with very many different fragments would make a shard
unbounded: windows of bytes are first dealt to chunks, each by the bytes that all its windows share, and only chunks
that meet again are judged; windows of words are counted one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglens.llm.common import bounds, columns_of, discard, fields, materialise, packed, slim, tune, whole_groups, with_row
from fraglens.llm.suffix import permuted_lcp, suffix_array

WIDTH, GRAM = 400, 32
#: Different fragments of an anchor that a shard takes; anchors with more are refined.
HOT = 768
CHUNKS = (32, 4)
#: Bytes that never stand in UTF-8: between fragments, and after the last.
BETWEEN, AFTER = 0xFF, 0xC0
#: Bytes of text that are hashed at once, so few that they stay in a core's cache; fragments that are read at once, and bytes of theirs that a suffix array takes (or one anchor).
SLAB, ROWS, SHARD = 1 << 16, 8192, 3 << 20
#: Words of an anchor of a window of words, and bytes of a word that is spelt out; longer ones are told apart by a 128-bit hash.
ANCHOR_WORDS, SPELT = 8, 32
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_SPAN = "array<struct<lo: int, hi: int, words: boolean>>"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    h, base, size = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    while size < GRAM:
        h = h[:-size] * base + h[size:]
        base, size = np.uint64((int(base) * int(base)) % 2**64), 2 * size
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _leftmost_least(h: np.ndarray, span: int) -> np.ndarray:
    """Of each run of span hashes, the place of the one with the least upper 36 bits (the leftmost of equals)."""
    least = (h >> np.uint64(28) << np.uint64(28)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if span > step:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    return (least & np.uint64((1 << 28) - 1)).astype(np.int64)


def fragments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(index of the text, first window, windows, anchor's place after it, anchor's hash) of each fragment."""
    at = 0
    while at < len(texts):
        top, size = at + 1, len(texts[at])
        while top < len(texts) and size + len(texts[top]) <= SLAB:
            size += len(texts[top])
            top += 1
        lengths = np.fromiter((len(t) for t in texts[at:top]), dtype=np.int64, count=top - at)
        data = np.frombuffer(b"".join(texts[at:top]), dtype=np.uint8)
        if len(data) >= WIDTH and (lengths >= WIDTH).any():
            h = _gram_hashes(data)
            anchor = _leftmost_least(h, WIDTH - GRAM + 1)
            ends = np.cumsum(lengths)
            doc = np.repeat(np.arange(top - at), lengths)[: len(anchor)]
            inside = np.arange(len(anchor)) + WIDTH <= ends[doc]
            where = np.flatnonzero(inside)
            if len(where):
                cuts = bounds(anchor[where])  # a text's windows never share an anchor place with another's
                first, n = where[cuts[:-1]], np.diff(cuts)
                start = (ends - lengths)[doc[first]]
                yield doc[first] + at, first - start, n, anchor[first] - first, h[anchor[first]].view(np.int64)
        at = top


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it."""
    solid = ~_SPACE[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_fragments(texts: list[bytes], words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(index of the text, first window, windows, anchor's place after it, anchor's hash) of each fragment of windows of `words` words."""
    short = min(ANCHOR_WORDS, words)
    at = 0
    while at < len(texts):
        doc: list[int] = []
        w: list[int] = []
        lengths: list[int] = []
        while at < len(texts) and len(w) < SLAB >> 3:  # as many hashes as stay in a core's cache
            own = texts[at].split()
            if len(own) >= words:
                doc.append(at)
                lengths.append(len(own))
                w.extend(map(xxhash.xxh64_intdigest, own))
            at += 1
        if not doc:
            continue
        hashes, n = np.array(w, dtype=np.uint64), len(w)
        h = np.zeros(n - short + 1, dtype=np.uint64)
        for i in range(short):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - short + 1 + i]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        place = _leftmost_least(h, words - short + 1)
        ends = np.cumsum(lengths)
        own = np.repeat(np.arange(len(doc)), lengths)[: len(place)]
        where = np.flatnonzero(np.arange(len(place)) + words <= ends[own])
        cuts = bounds(place[where])  # a text's windows never share an anchor place with another's
        first, many = where[cuts[:-1]], np.diff(cuts)
        start = (ends - lengths)[own[first]]
        yield np.array(doc)[own[first]], first - start, many, place[first] - first, h[place[first]].view(np.int64)


def _spelt(own: list[bytes]) -> list[bytes]:
    """The words as they are spelt in a fragment, where one space stands before each and one after the last."""
    return [w if len(w) <= SPELT else b"\x01" + xxhash.xxh3_128_hexdigest(w).encode() for w in own]


def _occurrences(words: int | None):
    """One row for each text and anchor: where its fragments stand in the text."""
    at_kind = pa.struct([("first", pa.int32()), ("n", pa.int32()), ("place", pa.int32())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in b.column(1).to_pylist()]
            parts = [(doc, first, n, place, key, np.zeros(len(key), dtype=bool)) for doc, first, n, place, key in fragments(texts)]
            if words is not None:
                parts += [(doc, first, n, place, key, np.ones(len(key), dtype=bool)) for doc, first, n, place, key in word_fragments(texts, words)]
            if not parts:
                continue
            doc, first, n, place, key, by_words = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((first, key, doc, by_words))
            doc, first, n, place, key, by_words = (x[order] for x in (doc, first, n, place, key, by_words))
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (by_words[1:] != by_words[:-1])]))
            whole = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (first, n, place)], fields=list(at_kind))
            at = pa.ListArray.from_arrays(pa.array(np.append(new, len(key)).astype(np.int32)), whole)
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(by_words[new]), b.column(0).take(pa.array(doc[new])), at], ["key", "words", "t", "at"])

    return run


def _cut(words: int | None):
    """The fragments that each text is asked for, with what they cover; equal ones of a text are one row."""
    types = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.binary()]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, text, asked in zip(*(b.column(c).to_pylist() for c in ("t", "text", "asked")), strict=True):
                raw = text.encode()
                own = _spelt(raw.split()) if any(a["words"] for a in asked) else []
                rows: list[list] = [[] for _ in types]
                for a in asked:
                    equal: dict[tuple[int, bytes], list[int]] = {}
                    for x in a["at"]:
                        i, n = x["first"], x["n"]
                        content = b" %b " % b" ".join(own[i : i + n + words - 1]) if a["words"] else raw[i : i + n + WIDTH - 1]
                        equal.setdefault((x["place"], content), []).append(i)
                    for (place, content), firsts in equal.items():
                        for c, v in zip(rows, (a["key"], a["words"], xxhash.xxh3_128_digest(content), t, firsts, place, content), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, types, strict=True)], ["key", "words", "digest", "t", "firsts", "place", "content"])

    return lambda batches: packed(run(batches))


def _runs(mask: np.ndarray) -> np.ndarray:
    """(first, last) of each run of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1)


def _n_windows(content: bytes, words: int | None) -> int:
    return len(content) - WIDTH + 1 if words is None else content.count(b" ") - words


def _array_runs(parts: list[np.ndarray], step: int, width: int) -> list[list[list[int]]]:
    """Runs of windows (width bytes, from every step-th byte) of each part that also start elsewhere, by a suffix array."""
    data = np.full(sum(map(len, parts)) + len(parts), BETWEEN, dtype=np.uint8)
    cuts = np.cumsum([0, *(len(x) + 1 for x in parts)])
    for x, a in zip(parts, cuts, strict=False):
        data[a : a + len(x)] = x
    data = data[:-1]
    order = suffix_array(data)
    shared = permuted_lcp(data, order, AFTER)
    most = shared.copy()
    most[order[:-1]] = np.maximum(most[order[:-1]], shared[order[1:]])
    return [_runs(most[a : a + max(0, len(x) - width + 1) : step] >= width).tolist() for x, a in zip(parts, cuts, strict=False)]


def _chunks(contents: list[bytes], places: list[int]) -> tuple[list[set[tuple[int, int]]], dict[bytes, list[tuple[int, int, int]]]]:
    """Of the different fragments of an anchor: runs of windows that surely repeat, and what is left to judge.

    Windows go to chunks of CHUNKS[0] places before the anchor, by the bytes that all windows of the chunk share. Those
    that share them with no other fragment repeat nowhere; chunks that are equal as a whole repeat.
    """
    g = CHUNKS[0]
    by_core: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
    for k, (content, place) in enumerate(zip(contents, places, strict=True)):
        last = len(content) - WIDTH
        for chunk in range((place - last) // g, place // g + 1):
            at = place - chunk * g
            by_core.setdefault((chunk, content[at : at + WIDTH + 1 - g]), []).append((k, max(0, at - g + 1), min(last, at)))
    known: list[set[tuple[int, int]]] = [set() for _ in contents]
    left: dict[bytes, list[tuple[int, int, int]]] = {}
    for members in by_core.values():
        if len(members) > 1:
            same: dict[bytes, list[tuple[int, int, int]]] = {}
            for k, lo, hi in members:
                same.setdefault(contents[k][lo : hi + WIDTH], []).append((k, lo, hi))
            for content, own in same.items():
                if len(own) > 1:
                    for k, lo, hi in own:
                        known[k].add((lo, hi))
                if len(same) > 1:
                    left.setdefault(content, []).extend(own)
    return known, left


def _byte_runs(groups: list[tuple[list[bytes], list[int]]]) -> list[list[list[list[int]]]]:
    """Runs of repeated windows of bytes of each fragment, for several anchors."""
    judged = [_chunks(*g) for g in groups]
    parts = [c for _, left in judged for c in left]
    found = iter(_array_runs([np.frombuffer(c, dtype=np.uint8) for c in parts], 1, WIDTH)) if parts else iter(())
    out = []
    for known, left in judged:
        runs = [set(k) for k in known]
        for own in left.values():
            for a, b in next(found):
                for k, lo, _ in own:
                    runs[k].add((lo + a, lo + b))
        out.append([[[a, b - 1] for a, b in _merged([(a, b + 1) for a, b in r])] for r in runs])
    return out


def _word_runs(groups: list[list[bytes]], words: int) -> list[list[list[list[int]]]]:
    """Runs of repeated windows of words of each fragment, for several anchors.

    Words are numbered, and spelt by digits that tell their places apart, so that no window starts within a word.
    """
    number: dict[bytes, int] = {}
    own = [np.array([number.setdefault(w, len(number)) for w in c.split()], dtype=np.int64) for g in groups for c in g]
    digits = 2 if len(number) <= 100**2 else 4
    base = 200 // digits
    code = np.stack([np.arange(len(number)) // base**d % base + base * d for d in range(digits)], axis=1).astype(np.uint8)
    parts = [code[c].ravel() for c in own]
    found = iter(_array_runs(parts, digits, digits * words))
    return [[next(found) for _ in g] for g in groups]


def _judge(words: int | None):
    """Runs of repeated windows of each distinct fragment; whole anchors at a time."""
    span = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key"], rows=ROWS):
            key, by_words = (table.column(c).to_numpy() for c in ("key", "words"))
            contents, copies, places = (table.column(c).to_pylist() for c in ("content", "copies", "place"))
            spans: list[list] = [[] for _ in contents]
            for flag in (False, True):
                own = np.flatnonzero(by_words == flag)
                cuts = bounds(key[own])
                held: list[list[int]] = []
                size = 0
                for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if z - a > 1:
                        held.append(own[a:z].tolist())
                        size += sum(len(contents[i]) for i in held[-1])
                    if held and (z == len(own) or size >= SHARD):
                        what = [[contents[i] for i in g] for g in held]
                        runs = _word_runs(what, words) if flag else _byte_runs([(c, [places[i] for i in g]) for c, g in zip(what, held, strict=True)])
                        for g, found in zip(held, runs, strict=True):
                            for i, r in zip(g, found, strict=True):
                                spans[i] = r
                        held, size = [], 0
            for i, n in enumerate(copies):
                if n > 1:
                    spans[i] = [[0, _n_windows(contents[i], words if by_words[i] else None) - 1]]
            flat = [{"lo": a, "hi": b} for s in spans for a, b in s]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), table.column("digest").combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, span))], ["key", "digest", "spans"])

    return run


def _refine(g: int):
    """Deals windows of hot fragments to chunks of g places before the anchor, keyed by what their windows share."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for key, digest, place, copies, base, content in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "place", "copies", "base", "content")), strict=True):
                last = len(content) - WIDTH  # windows 0..last, their anchors at place - p
                for chunk in range((place - last) // g, place // g + 1):
                    lo, hi = max(0, place - chunk * g - g + 1), min(last, place - chunk * g)
                    core = content[place - chunk * g : place - chunk * g + WIDTH + 1 - g]
                    sub = xxhash.xxh3_128_digest(b"%d:%d:" % (key, chunk) + core)
                    for c, v in zip(rows, (key, digest, sub, place - lo, copies, base + lo, content[lo : hi + WIDTH]), strict=True):
                        c.append(v)
            types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["key", "digest", "sub", "place", "copies", "base", "content"])

    return run


def _word_windows(words: int):
    """(key, digest, sub, copies, base): single windows of hot fragments, by what they cover."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            for key, digest, copies, content in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "copies", "content")), strict=True):
                space = np.flatnonzero(np.frombuffer(content, dtype=np.uint8) == 32).tolist()
                for i, (a, z) in enumerate(zip(space, space[words:], strict=False)):
                    for c, v in zip(rows, (key, digest, xxhash.xxh3_128_digest(content[a:z]), copies, i), strict=True):
                        c.append(v)
            types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["key", "digest", "sub", "copies", "base"])

    return run


def repeated_spans(docs: DataFrame, words: int | None = None) -> DataFrame:
    """(t, spans) of each distinct text that repeats somewhere: runs [lo, hi) of bytes, or of words where `words` says so, unmerged.

    docs has t (binary, equal for equal texts) and text (no nulls) and doc_id. A text with copies has the run [0, -1),
    which stands for all of it.
    """
    found = materialise(docs.select("t", "text").mapInArrow(slim(_occurrences(words)), "key long, words boolean, t binary, at array<struct<first: int, n: int, place: int>>"))
    texts_of = F.xxhash64("t")  # narrower than t, and no sort is needed to compare it
    often = found.groupBy("key").agg(F.min(texts_of).alias("low"), F.max(texts_of).alias("high"), F.max(F.size("at")).alias("most")).where("low < high or most > 1").select("key")
    asked = found.join(often, "key", "left_semi").groupBy("t").agg(F.collect_set(F.struct("key", "words", "at")).alias("asked"))
    texts = docs.groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    source = docs.select("t", "doc_id", "text").alias("d").join(asked.join(texts, "t").alias("a"), F.expr("d.t = a.t and d.doc_id <=> a.doc_id")).select("d.t", "d.text", "a.asked")
    cut_rows = materialise(source.mapInArrow(slim(_cut(words)), "key long, words boolean, digest binary, t binary, firsts array<int>, place int, content binary"))
    discard(found)
    cut = cut_rows.withColumn("copies", F.size("firsts").cast("long"))
    spans = "key long, digest binary, spans array<struct<lo: int, hi: int>>"
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = materialise(cut.select("key", "digest").distinct().groupBy("key").count().where(F.col("count") > HOT).select("key"))
    cold, hot = (cut, None) if many.isEmpty() else (cut.join(many, "key", "left_anti"), cut.join(many, "key", "left_semi"))
    distinct = cold.groupBy("key", "digest").agg(F.first("words").alias("words"), F.first("place").alias("place"), F.sum("copies").alias("copies"), F.max("content").alias("content"))
    judged = distinct.repartition(n, "key").sortWithinPartitions("key").mapInArrow(slim(_judge(words)), spans)
    if hot is not None:
        judged = judged.unionByName(_hot_spans(hot.where("not words"), n))
        if words is not None:
            judged = judged.unionByName(_hot_word_spans(hot.where("words"), words))
    judged = materialise(judged.where(F.size("spans") > 0))  # each step written by itself: its shuffle files go before the next
    members = cut.select("key", "words", "digest", "t", "firsts").join(judged, ["key", "digest"])
    width = F.when(F.col("words"), F.lit(words or 0)).otherwise(F.lit(WIDTH))
    moved = F.flatten(F.transform("firsts", lambda f: F.transform("spans", lambda s: F.struct((s.lo + f).alias("lo"), (s.hi + f + width).alias("hi"), F.col("words").alias("words")))))
    whole = texts.where("copies > 1").select("t", F.expr("array(named_struct('lo', 0, 'hi', -1, 'words', false))").cast(_SPAN).alias("spans"))
    out = materialise(members.select("t", moved.cast(_SPAN).alias("spans")).unionByName(whole).groupBy("t").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    discard(cut_rows)
    discard(judged)
    return out


def _refined(left: DataFrame, g: int) -> DataFrame:
    """The chunks of g places of hot fragments that occur more than once."""
    dealt = materialise(left.mapInArrow(_refine(g), "key long, digest binary, sub binary, place int, copies long, base int, content binary"))
    again = dealt.groupBy("sub").agg(F.sum("copies").alias("all")).where("all > 1").select("sub")
    return dealt.join(again, "sub")


def _hot_word_spans(hot: DataFrame, words: int) -> DataFrame:
    """Runs of repeated windows of words of the fragments of very frequent anchors."""
    left = hot.groupBy("key", "digest").agg(F.sum("copies").alias("copies"), F.max("content").alias("content"))
    dealt = materialise(left.mapInArrow(_word_windows(words), "key long, digest binary, sub binary, copies long, base int"))
    again = dealt.groupBy("sub").agg(F.sum("copies").alias("all")).where("all > 1").select("sub")
    return dealt.join(again, "sub", "left_semi").groupBy("key", "digest").agg(F.collect_list(F.struct(F.col("base").alias("lo"), F.col("base").alias("hi"))).alias("spans"))


def _hot_spans(hot: DataFrame, n: int) -> DataFrame:
    """Runs of repeated windows of the fragments of very frequent anchors.

    Chunks that share their core are judged by suffix arrays like any anchor; where even these are too many distinct
    ones, single windows are counted.
    """
    left = hot.groupBy("key", "digest", "place").agg(F.sum("copies").alias("copies"), F.max("content").alias("content")).withColumn("base", F.lit(0))
    for g in CHUNKS:
        left = _refined(left.drop("sub"), g)
    items = materialise(left.withColumn("whole", F.concat("sub", F.unhex(F.md5("content")))))
    distinct = materialise(items.groupBy("sub", "whole").agg(F.first("place").alias("place"), F.sum("copies").alias("copies"), F.max("content").alias("content")))
    many = distinct.groupBy("sub").count().where(F.col("count") > HOT).select("sub")
    few = distinct.join(many, "sub", "left_anti").select(F.xxhash64("sub").alias("key"), F.lit(False).alias("words"), F.col("whole").alias("digest"), "place", "copies", "content")
    spans = "array<struct<lo: int, hi: int>>"
    judged = few.repartition(n, "key").sortWithinPartitions("key").mapInArrow(slim(_judge(None)), f"key long, digest binary, spans {spans}").where(F.size("spans") > 0)
    moved = F.transform("spans", lambda s: F.struct((s.lo + F.col("base")).alias("lo"), (s.hi + F.col("base")).alias("hi")))
    out = items.join(judged.select(F.col("digest").alias("whole"), "spans"), "whole").select("key", "digest", moved.alias("spans"))
    rest = items.join(many, "sub", "left_semi").drop("sub", "whole")
    if not rest.isEmpty():
        out = out.unionByName(_refined(rest, 1).select("key", "digest", F.array(F.struct(F.col("base").alias("lo"), F.col("base").alias("hi"))).alias("spans")))
    return out.groupBy("key", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def byte_runs(raw: bytes, spans: list[dict], words: int | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximal runs of bytes that the windows of bytes among spans cover, and that all of them cover."""
    whole = any(s["hi"] < 0 for s in spans)
    own = [(0, len(raw))] if whole and len(raw) >= WIDTH else [(s["lo"], s["hi"]) for s in spans if not s["words"] and s["hi"] > 0]
    by_words = [(s["lo"], s["hi"]) for s in spans if s["words"]]
    long = _merged(own)
    if words is None or not (whole or by_words):
        return long, long
    first, after = word_places(raw)
    if whole:
        by_words = [(0, len(first))] if len(first) >= words else []
    return long, _merged(long + [(int(first[a]), int(after[z - 1])) for a, z in by_words])


def _without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *(hi for _, hi in gone)], [*(lo for lo, _ in gone), len(raw)], strict=True))


OUTPUT = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def cut_repeats(docs: DataFrame, words: int | None = None, counts: bool = True) -> DataFrame:
    """docs (doc_id, text and more) with text cut, and, unless counts is false, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte that a WIDTH-byte string covers which also starts anywhere else, in the same text or another, is
    removed; n_removed, n_spans (maximal runs) and kept_sha256 (of the remaining bytes) are of this alone. If `words`
    is given, text also lacks each passage of so many words that stands anywhere else, however few its bytes; words are
    told apart by bytes, and what stands between them doesn't matter. Strings are judged on the input, and none crosses
    texts; texts are read whole, however long. A null text counts as empty and stays null. The text returned is what
    remains, without the parts of characters that a cut leaves. Repeated rows are copies of each other; shorter texts
    stay whole; an empty table gives an empty result. Extra columns are kept, whatever their names, but those named like
    the four counts give way to them.
    """
    tune(docs.sparkSession)
    kept = [c for c in docs.columns if not counts or c not in OUTPUT]
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct(*columns_of(docs, ["text", *(OUTPUT if counts else ())])).alias("row"), F.col("text").isNull().alias("absent"), text.alias("text"), F.unhex(F.md5(text)).alias("t"))
    rows = keyed.join(repeated_spans(keyed.select("t", F.col("row.doc_id").alias("doc_id"), "text"), words), "t", "left")
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in types]
            for text, absent, spans in zip(*(b.column(c).to_pylist() for c in ("text", "absent", "spans")), strict=True):
                raw = text.encode()
                long, gone = byte_runs(raw, spans or [], words)
                left = _without(raw, long)
                values = (None if absent else text if not gone else _without(raw, gone).decode("utf-8", "ignore"), len(raw), len(raw) - len(left), len(long), hashlib.sha256(left).hexdigest())
                for c, v in zip(out, values, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["row", "text", *OUTPUT])

    done = rows.select("row", "text", "absent", "spans").mapInArrow(slim(run), with_row(keyed, "text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    return done.select(*fields(kept), *(OUTPUT if counts else ()))
