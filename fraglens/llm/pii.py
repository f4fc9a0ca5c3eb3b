"""Personal data: fixed formats, and unseen identifiers found by bootstrapped contexts.

Matches of the fixed formats, and quoted keys of many hexadecimal digits, are seed instances. The word before an
instance, the two words before it, and the sign between are its patterns. Over the graph of patterns and instances, a
pattern's confidence for a kind is the lower bound of the mean score of its instances, an instance's score that of its
patterns combined; both are computed in turns by Spark. Identifiers that no format matches are added where patterns of
high confidence lead to them, and so are keys; a key without such a pattern stays.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglens.llm.common import columns_of, discard, fields, materialise, slim, tune, with_row

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What may be an identifier that no format matches: a word with a digit or @ in it, of 6 to 64 characters.
_LIKELY = re.compile(r"(?<!\S)(?=\S{0,63}[0-9@])\S{6,64}(?!\S)")
_AROUND = ".,;:!?%&$#*\"'()[]<>"
_KEY = re.compile(r"(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}")
_BEFORE = re.compile(r"(?:([^\W\d_]+)[\s:=]+)?([^\W\d_]+)[ \t]*([:=]?)[ \t]*[\"']?$")
CONTEXT_CHARS = 80
#: Distinct seeds that a pattern needs, confidence that it needs (lower bound at Z deviations), score that an instance needs, turns.
SUPPORT, CONFIDENCE, Z, SCORE, TURNS = 4, 0.6, 1.96, 0.6, 3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        local = len(text[done:at]) - len(text[done:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if local else None
        if found:
            out.append((at - local, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    return out


def _byte(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats by kind, then start; failing matches are dropped, not tried again.

    Each run of characters is read a bounded number of times, so that the time is linear in the text.
    """
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _patterns(text: str, start: int) -> list[str]:
    """The word before start with the sign between, and the two words before it."""
    found = _BEFORE.search(text[max(0, start - CONTEXT_CHARS) : start])
    if not found:
        return []
    near = f"{found[2]}{found[3]}".lower()
    return [near, f"{found[1].lower()} {near}"] if found[1] else [near]


def _spelt(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _candidates(text: str, spans: list[tuple[int, int, int]]):
    """(kind or -1, start, end) of seeds, and of words that may be identifiers."""
    yield from spans
    taken = sorted((s, e) for _, s, e in spans)
    at = 0
    for m in _LIKELY.finditer(text):
        word = m[0].rstrip(_AROUND)
        start, end = m.end() - len(m[0].lstrip(_AROUND)), m.start() + len(word)
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if end - start >= 6 and not any(s < end for s, _ in taken[at : at + 1]):
            quoted = text[start - 1 : start] in ("'", '"') and text[start - 1 : start] == text[end : end + 1]
            yield SECRET if quoted and _KEY.fullmatch(text, start, end) else -1, start, end


def _scan(batches):
    """Per row the base spans, and candidates: (kind or -1, start, end, patterns, instance)."""
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string())), ("instance", pa.string())])
    for b in batches:
        base, seen = [], []
        for text in b.column("text").to_pylist():
            spans = base_spans(text)
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            found = []
            if spans or "@" in text or _DIGIT.search(text):
                for k, s, e in _candidates(text, spans):
                    if p := _patterns(text, s):
                        instance = text[s:e] if e - s <= 64 else hashlib.sha256(text[s:e].encode()).hexdigest()
                        found.append({"kind": k, "start": s, "end": e, "patterns": p, "instance": instance})
            seen.append(found)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("t"), pa.array(base, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))), pa.array(seen, pa.list_(kind))], ["row", "t", "base", "seen"])


def learnt_spans(scanned: DataFrame) -> DataFrame:
    """(t, added array<struct<kind, start, end>>) of identifiers that confident patterns lead to."""
    edges = materialise(scanned.select("t", F.explode("seen").alias("s")).select("t", "s.kind", "s.start", "s.end", "s.instance", F.explode("s.patterns").alias("pattern")))
    links = edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    strong = links.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    graph = materialise(links.join(strong.select("pattern").distinct(), "pattern", "left_semi"))
    none = edges.where("false").select("t", F.array(F.struct("kind", "start", "end")).alias("added"))
    if graph.where(f"kind not between 0 and {SECRET - 1}").isEmpty():
        discard(graph)
        return none
    seeds = graph.where("kind >= 0").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    score = seeds
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    for _ in range(TURNS):
        sums = graph.select("pattern", "instance").join(score, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
        n, p = F.col("n"), F.least(F.col("s") / F.col("n"), F.lit(1.0))
        low = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)  # Wilson's interval
        sure = materialise(sums.join(sizes, "pattern").join(strong.select("pattern", "kind"), ["pattern", "kind"], "left_semi").select("pattern", "kind", low.alias("confidence")).where(F.col("confidence") >= CONFIDENCE))
        miss = F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))
        grown = graph.where("kind < 0").join(sure, "pattern").groupBy("instance", sure["kind"]).agg((1 - F.exp(miss)).alias("score"))
        score = materialise(seeds.unionByName(grown))
    found = score.where(F.col("score") >= SCORE).join(seeds.where(F.col("kind") < SECRET).select("instance"), "instance", "left_anti")
    digits = F.regexp_count("instance", F.lit("[0-9]"))
    key = (F.length("instance") >= 16) & F.col("instance").rlike("[0-9]") & F.col("instance").rlike("[A-Za-z]")
    fits = F.when(F.col("kind") == 0, F.col("instance").contains("@")).when(F.col("kind") == 1, (digits >= 4) & F.col("instance").rlike("[.:]")).when(F.col("kind") == 2, digits >= 12).when(F.col("kind") == 3, digits >= 7).otherwise(key)
    found = found.where(fits).groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("as"))
    hits = edges.where(f"kind not between 0 and {SECRET - 1}").join(found, "instance").join(sure.select("pattern", F.col("kind").alias("as")), ["pattern", "as"], "left_semi")
    return hits.groupBy("t").agg(F.collect_set(F.struct(F.col("as").alias("kind"), "start", "end")).alias("added"))


def _keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*keep).alias("row"), text.alias("text"), F.unhex(F.md5(text)).alias("t"))


def _scanned(keyed: DataFrame) -> DataFrame:
    span = "array<struct<kind: int, start: int, end: int>>"
    return keyed.mapInArrow(slim(_scan), with_row(keyed, f"t binary, base {span}, seen array<struct<kind: int, start: int, end: int, patterns: array<string>, instance: string>>"))


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of docs (doc_id, text).

    Counts and base_sha256 are of the fixed formats; spans holds these and those that the contexts add, as
    kind:start:end (code points, end exclusive) by kind (secret last), then start. A null or empty text has none.
    Repeated rows have equal spans; texts are read whole, in time that grows with their length; an empty table gives an
    empty result, and other columns than the two play no part. Identifiers that contexts add have 6 to 64 characters.
    """
    tune(docs.sparkSession)
    scanned = materialise(_scanned(_keyed(docs, ["doc_id"])))
    rows = scanned.select("row.doc_id", "t", "base").join(learnt_spans(scanned), "t", "left")

    def spell(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for base, added in zip(b.column("base").to_pylist(), b.column("added").to_pylist(), strict=True):
                own = [(s["kind"], s["start"], s["end"]) for s in base]
                more = [(s["kind"], s["start"], s["end"]) for s in added or ()]
                counts = [sum(k == i for k, _, _ in own) for i in range(4)]
                for c, v in zip(out, (*counts, hashlib.sha256(_spelt(own).encode()).hexdigest(), _spelt(sorted(own + more)), len(more)), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "base", "added").mapInArrow(slim(spell), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data in text replaced by its kind in brackets, such as [EMAIL].

    Overlapping spans become one, named after the first. Null texts stay null; all columns are kept, whatever their names.
    """
    tune(docs.sparkSession)
    own = columns_of(docs, ["text"])
    scanned = materialise(_scanned(_keyed(docs.select("text"), ["text"]).withColumn("row", F.lit(0))))
    added = learnt_spans(scanned)
    span = "array<struct<kind: int, start: int, end: int>>"
    keyed = docs.select(F.struct(*own).alias("row"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("t"))
    some = materialise(added)
    keyed = keyed.withColumn("added", F.lit(None).cast(span)) if some.isEmpty() else keyed.join(some, "t", "left")

    def cover(batches):
        for b in batches:
            out = []
            for text, added in zip(b.column("text").to_pylist(), b.column("added").to_pylist(), strict=True):
                if text:
                    parts, at = [], 0
                    for s, e, k in sorted((s, e, k) for k, s, e in [*base_spans(text), *((x["kind"], x["start"], x["end"]) for x in added or ())]):
                        if s >= at:
                            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], ["row", "text"])

    done = keyed.select("row", "text", "added").mapInArrow(slim(cover), with_row(keyed, "text string"))
    return done.select(*fields(docs.columns))
