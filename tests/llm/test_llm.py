"""Each training-data operator against plain code on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

P = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared = _text(rng, 90)
    out = [(i, _text(rng, rng.randrange(1, 120)), "en", "s", 0) for i in range(40)]
    long = _text(rng, 3000)
    out += [(40, None, None, None, None), (41, "", "en", "s", 0), (42, "  \n\t ", "en", "s", 0), (43, long, "en", "s", 0)]
    out += [(44 + k, out[5][1], "en", "s", 0) for k in range(3)]  # exact copies
    out += [(50 + k, f"{_text(rng, 9)} {shared} {_text(rng, 9)}", "en", "s", 0) for k in range(4)]
    out += [(60, out[7][1], "en", "s", 0), (60, out[7][1], "en", "s", 0)]  # a repeated row
    words = long.split()
    words[100] = "changed"
    out += [(70, " ".join(words), "en", "s", 0), (71, "é à ü▁x 日本 \x00 a  b   c\n\n d", "fr", "s", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _vectors(spark, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(120, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    rows += [(200 + i, (base[3] + 0.05 * rng.normal(size=8)).astype(np.float32).tolist(), 1) for i in range(20)]
    rows += [(300, base[4].tolist(), 1), (301, base[4].tolist(), 1), (400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [None] * 8, 0), (404, [1.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("block", [40, 8192])
def test_top_k(spark, monkeypatch, block):
    from fraglens.llm import topk
    from fraglens.llm.topk import top_k

    monkeypatch.setattr(topk, "BLOCK", block)
    rows, df = _vectors(spark)
    ok = [(i, np.floor(256 * np.asarray(v, dtype=np.float32).astype(float)).astype(int)) for i, v, _ in rows if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, a in ok:
        if q % 50 == 0:
            best = sorted(((-int(a @ b), i) for i, b in ok if i != q))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = {tuple(r) for r in top_k(df, "vec_id % 50 = 0", 5).collect()}
    assert got == want
    assert top_k(df.where("false"), "vec_id % 50 = 0").count() == 0


def test_lists_are_read_in_part():
    from fraglens.llm.topk import SortedLists

    rng = np.random.default_rng(5)
    v = np.floor(256 * (rng.normal(size=(40, 32))[rng.integers(40, size=3000)] + 0.02 * rng.normal(size=(3000, 32))))
    queries = v[::100]
    lists = SortedLists(v)
    for q, found in zip(queries, lists.candidates(queries, 6), strict=True):
        scores = v @ q
        assert set(np.flatnonzero(scores >= np.sort(scores)[-6])) <= set(found.tolist())
    assert lists.reads < 0.9 * len(queries) * v.size


def test_top_k_of_very_large_numbers(spark):
    from fraglens.llm.topk import top_k

    df = spark.createDataFrame([(0, [1e17, 1.0]), (1, [3e17, 2.0]), (2, [3e17, 3.0]), (3, [-1e300, 1e300])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in top_k(df, "vec_id = 0").orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, 2**63 - 1), (3, -(2**63))]


def test_near_duplicate_vectors(spark):
    from fraglens.llm.pq_dedup import near_duplicates

    rows, df = _vectors(spark)
    u = {i: np.asarray(v, dtype=np.float32).astype(float) for i, v, _ in rows if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    u = {i: v / np.linalg.norm(v) for i, v in u.items()}
    near = {i: {j for j in u if j != i and u[i] @ u[j] >= 0.9} for i in u}
    root = {i: i for i, *_ in rows}
    for _ in rows:
        for i in near:
            root[i] = min([root[i], *(root[j] for j in near[i])])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {i: (len(near.get(i, ())), root[i], root[i] == i) for i, *_ in rows}
    assert near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [8192, 500])
def test_near_duplicate_vectors_near_a_subspace(spark, monkeypatch, block):
    from fraglens.llm import pq_dedup

    monkeypatch.setattr(pq_dedup, "BLOCK", block)
    rng = np.random.default_rng(6)
    v = (rng.normal(size=(3000, 4)) @ rng.normal(size=(4, 64)) + 0.15 * rng.normal(size=(3000, 64))).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in pq_dedup.near_duplicates(df, recall=1.0).collect()}
    assert got == {i: int(near[i].sum()) - 1 for i in range(len(v))}


@pytest.mark.parametrize("rank", [2, 4, 64])
def test_recall_of_near_duplicate_vectors(spark, rank):
    from fraglens.llm.pq_dedup import near_duplicates

    rng = np.random.default_rng(rank)
    v = rng.normal(size=(4000, rank)) @ rng.normal(size=(rank, 64)) if rank < 64 else rng.normal(size=(4000, 64))
    v[2000:3000] = v[1000:2000] + 0.4 * np.linalg.norm(v[1000:2000], axis=1, keepdims=True) / 8 * rng.normal(size=(1000, 64))  # near copies
    v = v.astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = np.zeros(len(v), dtype=int)
    for r in near_duplicates(df).collect():
        got[r.vec_id] = r.n_links
    assert want.sum() > 500 and (got <= want).all() and got.sum() >= 0.99 * want.sum()


def _fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, none):
    from fraglens.llm.simhash import simhash_components

    fp = {i: _fingerprint(t) for i, t, *_ in rows}
    root = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            root[i] = min(root[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(docs).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in fp}
    assert simhash_components(none).count() == 0


def test_allocation_covers_tau():
    from fraglens.llm.simhash import allocate

    groups = [list(range(16 * g, 16 * g + 16)) for g in range(4)]
    for tau in (3, 6):
        parts = allocate(tau, groups, [np.array([1e6, 1e3, 1e3, 1e3])] * 4, 1e5)
        assert sum(t + 1 for _, t in parts) == tau + 1


def test_near_copies(docs):
    from fraglens.llm.simhash import near_copies

    root = {r.node: r.root for r in near_copies(docs.dropDuplicates(["doc_id"])).collect()}
    assert root[70] == 43 and root[44] == 5 and root[60] == 7 and 10 not in root


def _linked(texts, width=5):
    """The smallest index reachable from each text over pairs of Jaccard similarity 0.8."""
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return {i: x for i, x in enumerate(root) if i != x}


def test_near_copies_by_kind_of_edit(spark):
    from fraglens.llm.simhash import near_copies

    rng = random.Random(11)
    texts = []
    for k in range(120):
        words = _text(rng, rng.randrange(150, 400)).split()
        n = len(words)
        some = words[:]
        for i in rng.sample(range(n), n * 2 // 100):
            some[i] = "changed"
        copy = (words + _text(rng, n // 5).split(), words[: n - n * 15 // 100], words + _text(rng, n // 10).split(), some)[k % 4]
        texts += [" ".join(words), " ".join(copy)]
    want = _linked(texts)
    assert len(want) > 90
    got = near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.node: r.root for r in got.collect()} == want


def test_near_copies_in_groups_of_variants(spark, monkeypatch):
    from fraglens.llm import simhash

    rng = random.Random(12)
    texts = []
    for k in range(8):
        n = 180 + 10 * k
        words = _text(rng, n).split()
        for _ in range(25):
            own = words[:]
            for i in rng.sample(range(n), 3):
                own[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    want = _linked(texts)
    assert 20 < len(want) < 192
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.node: r.root for r in simhash.near_copies(docs).collect()} == want
    monkeypatch.setattr(simhash, "PAIRS_PER_ROW", 0)  # all chains first
    monkeypatch.setattr(simhash, "CHAINS", 2)
    assert {r.node: r.root for r in simhash.near_copies(docs).collect()} == want


def test_near_copies_compare_a_group_without_writing_its_pairs(spark, monkeypatch):
    from fraglens.llm import simhash

    rng = random.Random(14)
    words = _text(rng, 200).split()
    texts = []
    for k in range(240):  # most differ from each other by more than the similarity allows, but share rare shingles
        own = words[:]
        for i in rng.sample(range(200), 4 if k % 8 else 1):
            own[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    want = _linked(texts)
    sizes = []

    def counted(df, write=simhash.materialise):
        out = write(df)
        if df.columns == ["u", "v"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    got = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.node: r.root for r in got.collect()} == want
    assert max(sizes) <= 10 * len(texts)


def test_near_dedup_of_repeated_and_missing_ids(spark):
    import corpus_pipeline

    rng = random.Random(13)
    a, b, c = (_text(rng, 60) for _ in range(3))
    ids = [(5, a), (5, a), (5, b), (None, b), (None, c), (None, c), (3, f"{a} more"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ids], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(3, f"{a} more"), (5, b), (None, c), (None, None)], key=str)


@pytest.mark.parametrize("hot", [1, 512])
def test_repeats(spark, docs, rows, none, monkeypatch, hot):
    from fraglens.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    seen = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 399):
            seen[b[p : p + 400]] = seen.get(b[p : p + 400], 0) + 1
    want = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~gone])).hexdigest())
    out = suffix_dedup.cut_repeats(docs.withColumn("t", docs["lang"]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()}
    assert got == want and any(w[1] for w in want.values())
    assert out.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "t"]
    assert suffix_dedup.cut_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [1, 768])
def test_repeated_passages_of_few_bytes(spark, monkeypatch, hot):
    import corpus_pipeline
    from fraglens.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"{rng.choice('abcd')}{rng.randrange(10**4)}" for _ in range(n))
    long, short, twice = " ".join(rng.choice("abcdefghij") for _ in range(51)), fresh(50), fresh(51)
    texts = [f"{fresh(9)} {long} {fresh(70)}", f"{fresh(80)} {long}\n{fresh(3)}", f"{short} {fresh(60)}", f"{fresh(60)} {short}", f"{twice} {fresh(5)} {twice} end", fresh(200), None, "", long[:-2]]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, df, "").collect()}
    want = [t and t.replace(long, "").replace(twice, "") for t in texts]
    assert len(long) < 120 and got == dict(enumerate(want))


def test_repeats_keep_columns_of_any_name(spark):
    import corpus_pipeline
    from fraglens.llm.suffix_dedup import cut_repeats

    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, text, 5, "x", "y"), (2, text, 6, "x", "z"), (None, "own", 7, "x", None)], "doc_id long, text string, n_bytes long, `a.b` string, quality_kept string")
    got = {r.doc_id: r for r in corpus_pipeline.repeats(spark, df, "").collect()}
    assert [got[k].asDict() for k in (1, 2)] == [{"doc_id": k, "text": "", "n_bytes": n, "a.b": "x", "quality_kept": q} for k, n, q in ((1, 5, "y"), (2, 6, "z"))]
    assert got[None].text == "own" and got[None].n_bytes == 7
    assert {r.doc_id: (r.n_bytes, r["a.b"]) for r in cut_repeats(df).collect()} == {1: (len(text), "x"), 2: (len(text), "x"), None: (3, "x")}
    same = {r.doc_id: r.asDict() for r in df.collect()}
    assert {r.doc_id: r.asDict() for r in corpus_pipeline.private_data(spark, df, "").collect()} == same
    kept = {r.doc_id: r.asDict() for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {k: same[k] for k in (1, None)}
    good = {r.doc_id: r.asDict() for r in corpus_pipeline.quality(spark, df, "").collect()}
    assert good.items() <= same.items()


def test_suffix_array():
    from fraglens.llm import suffix

    rng = np.random.default_rng(0)
    for _ in range(100):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(1, 50)).astype(np.uint8)
        b = s.tobytes()
        order = suffix.suffix_array(s)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        plcp = suffix.permuted_lcp(s, order, 200)
        for i, j in zip(order[1:], order[:-1], strict=True):
            n = 0
            while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            assert plcp[i] == n


def test_private_data(spark, none):
    from fraglens.llm.pii import find_private, redact

    texts = ["mail a.b@c.org now", "host 10.0.0.255 and 300.1.1.1", "card 4111 1111 1111 1111 x", "call +1 (212) 555-0100.", "none", None, "", "1.2.3.4.5 +12 x@y"]
    texts += [f"ticket number {c}{i}@mail.example.com ok" for i, c in enumerate("abcdefghijkl")] + ["ticket number zed@@intranet9 ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in find_private(df).collect()}
    assert got[0].spans == "email:5:14" and got[0].n_email == 1
    assert got[1].spans == "ip:5:15" and got[1].n_ip == 1
    assert got[2].spans == "card:5:24"
    assert got[3].spans == "phone:5:22"
    assert got[4].spans == got[5].spans == got[6].spans == ""
    assert got[7].spans == "ip:0:7"
    assert got[0].base_sha256 == hashlib.sha256(b"email:5:14").hexdigest()
    keys = [f'note token = "{hashlib.sha1(str(i).encode()).hexdigest()}" here' for i in range(15)] + [f'TOKEN = "{hashlib.sha1(b"x").hexdigest().upper()}"!!', f'say {hashlib.sha1(b"y").hexdigest()} in passing']
    found = {r.doc_id: r for r in find_private(spark.createDataFrame(list(enumerate(keys)), "doc_id long, text string")).collect()}
    assert all(found[i].spans == "secret:14:54" and found[i].n_added == 1 for i in range(15))
    assert found[15].spans == "secret:9:49" and found[16].spans == ""
    assert got[20].n_email == 0 and got[20].spans == "email:14:28"  # only its context tells
    assert {r.doc_id: r.text for r in redact(df).collect()}[2] == "card [CARD] x"
    assert find_private(none).count() == 0 and redact(none).count() == 0


def _plain_spans(text):
    """The fixed formats as they are stated."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        if 16 <= len(d) <= 19 and sum(v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9) for i, v in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_fixed_formats_against_plain_patterns():
    import time

    from fraglens.llm.pii import base_spans

    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("a.@-+0127 5(é_%") for _ in range(rng.randrange(40)))
        assert base_spans(text) == _plain_spans(text)
    for _ in range(5_000):
        text = "".join(rng.choice("0123456789 -.+" if rng.random() < 0.1 else "0123456789") for _ in range(rng.randrange(60)))
        assert base_spans(text) == _plain_spans(text)
    assert base_spans("1" * 5000 + ".1.1.1") == [] and base_spans("0" * 5000 + "1.1.1.1") == [(1, 0, 5007)]
    for text in ("1" * 10**6, "a" * 10**6 + "@", "1." * 500_000, "+1" + " " * 10**6):
        began = time.process_time()
        base_spans(text)
        assert time.process_time() - began < 3


def test_private_data_of_documents(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = __spark_entry__.queries()["op5_private_contexts"](spark, sf).collect()
    assert len(got) == len(texts) and sum(r.n_added for r in got) > 0
    for r in got:
        base = _plain_spans(texts[r.doc_id])
        spelt = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(spelt.encode()).hexdigest()
        assert set(filter(None, spelt.split(","))) <= set(r.spans.split(","))


def test_toxicity(spark, none):
    from fraglens.llm.toxicity import fold, score_toxicity

    assert fold("You ST0OPID!!  ｉｄіоt c1own") == " you stoopid idiot ciown "
    rng = random.Random(1)
    rows = [(i, _text(rng, 40) + (" you absolute dunderhead!" if i % 3 == 0 else ""), i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "what a dund3rhe4d")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(df, labels).collect()}
    assert all(got[i].predicted == int(x) for i, _, x in rows)
    assert got[0].held_out == (zlib.crc32(b"0") % 5 == 0)
    assert got[900].score == got[901].score < 0.5 and got[902].predicted == 1
    assert score_toxicity(none, labels.where("false")).count() == 0
    assert score_toxicity(df, labels.where("false")).count() == 303


def test_sharding(docs, rows, none):
    from fraglens.llm.sharding import SlotMap, shard_documents

    got = shard_documents(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    text = {i: t or "" for i, t, *_ in rows}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    assert shard_documents(none).count() == 0
    sizes = np.random.default_rng(0).integers(1, 1000, 4096)
    first = SlotMap.initial(4096, 24).rebalanced(sizes, 24)
    loads = first.loads(sizes, 24)
    assert loads.max() - loads.min() < 50 and first.version == 2
    more = first.rebalanced(sizes, 25)
    assert (more.shard != first.shard).mean() < 0.1  # a 25th shard takes about its part


def test_sharding_edits_a_stored_map(spark, docs, rows, tmp_path):
    from fraglens.llm.sharding import shard_documents

    path = str(tmp_path / "map")
    first = shard_documents(docs, 5, 64, path).collect()
    texts = {i: t or "" for i, t, *_ in rows}
    homes = {}
    for r in first:
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())  # equal texts stay together
    again = shard_documents(docs, 5, 64, path).collect()
    assert {r.map_version for r in first} == {2} and {r.map_version for r in again} == {3}
    assert sorted(map(tuple, (r[:7] for r in first)), key=str) == sorted(map(tuple, (r[:7] for r in again)), key=str)
    fewer = shard_documents(docs, 4, 64, path).collect()
    moved = sum(a != b for a, b in ((dict((r.virtual_slot, r.shard) for r in x)[k], s) for x in (again,) for k, s in {r.virtual_slot: r.shard for r in fewer}.items()))
    assert {r.shard for r in fewer} <= set(range(4)) and moved <= 40
    with pytest.raises(ValueError):
        shard_documents(docs, 4, 128, path)


def test_sharding_splits_only_what_fits_no_shard(spark):
    from fraglens.llm.sharding import shard_documents

    df = spark.createDataFrame([(i, "x" * 92) for i in range(600)] + [(1000 + i, f"{i:03}" * 30) for i in range(900)], "doc_id long, text string")
    got = shard_documents(df, 6).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 200


def test_pieces(docs, rows, none):
    import sentencepiece

    from fraglens.llm.pieces import encode_documents, piece_codec

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = {i: t or "" for i, t, *_ in rows}
    for r in encode_documents(docs, path).collect():
        ids = sp.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert r.agrees and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    long = "ab" * 400
    assert piece_codec(path).encode([long])[0] == np.asarray(sp.encode(long, add_bos=True, add_eos=True), dtype="<u4").tobytes()
    assert encode_documents(none, path).count() == 0


def test_quality(spark, none):
    from fraglens.llm.quality import estimate, score_quality

    rng = random.Random(2)
    plain = [re.sub(r"\d", "", _text(rng, 60)).capitalize() + "." for _ in range(160)]
    junk = [" ".join(w + "%%%" for w in _text(rng, 40).split()) for _ in range(20)] + [" | ".join(_text(rng, 40).split()) for _ in range(20)] + ["spam " * 60 for _ in range(10)]
    texts = plain + junk + [None, "", "  "]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, quality_note string")
    got = {r.doc_id: r.quality_kept for r in score_quality(df).collect()}
    assert all(got[i] for i in range(160)) and sum(got[i] for i in range(160, 210)) <= 1 and not any(got[i] for i in range(210, 213))
    assert score_quality(none).count() == 0
    _, bad, posterior = estimate(np.array([[1, 1, 1], [2, 1, 1]]), np.array([900.0, 100.0]))
    assert 0 < bad < 0.5 and posterior[0] > posterior[1]


def test_quality_is_trained_on_whole_texts(spark, monkeypatch):
    from fraglens.llm import quality

    rng = random.Random(4)
    text = " ".join(["plain"] * 2 + [rng.choice(WORDS) for _ in range(5000)] + ["%%%"] * 300)
    seen = {}
    monkeypatch.setattr(quality, "train", lambda *a: seen.update(a=a) or (np.zeros(quality.FEATURES), 0.0))
    assert quality.score_quality(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).count() == 2
    want = np.bincount(quality.features(text, quality._Features()), minlength=quality.FEATURES)
    (got,), (counts,), _ = seen["a"]
    assert dict(zip(got.tolist(), counts.tolist(), strict=True)) == {i: int(n) for i, n in enumerate(want) if n}
    assert quality.shape("a" * 250 + "1") == "a+0"


def test_packing(spark, docs, rows, none):
    from tokenizers import Tokenizer

    from fraglens.llm.packing import best_fit, pack_documents, plan

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = pack_documents(docs, path).collect()
    text = {i: t or "" for i, t, *_ in rows}
    by, places = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(text)
    for i, pieces in by.items():
        ids = [*tok.encode(text[i], add_special_tokens=False).ids, 2]
        copies = sum(x[0] == i for x in rows)
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            raw = np.asarray(ids[p.start : p.start + p.length], dtype="<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(raw) and p.length <= 1024 and (p.length == 1024 or p.piece == 0)
    for runs in places.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= sum(r.length for r in got) / 1024 * 1.1 + 1
    assert pack_documents(none, path).count() == 0
    h = np.bincount(np.random.default_rng(0).integers(1, 1025, 20_000), minlength=1025)
    for chosen in (plan(h), best_fit(h)):
        used = np.zeros(1025, dtype=np.int64)
        for row, n in chosen:
            assert sum(row) <= 1024
            for v in row:
                used[v] += n
        assert (used == h).all()
        assert sum(n for _, n in chosen) <= 1.02 * (h * np.arange(1025)).sum() / 1024 + 1


def test_components(spark):
    from fraglens.llm.components import connected_components

    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75), (None, 3), (9, 9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 75: 50, 100: 50}


def test_pipeline_stages(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    step = docs.dropDuplicates(["doc_id"])
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in step.collect()}
        step = stage(spark, step, "").persist()
        after = {r.doc_id: r.text for r in step.collect()}
        assert step.columns == pipeline.COLUMNS and set(after) <= set(before), name
    assert pipeline.STAGES[-1][1](spark, step, "").select("doc_id").distinct().count() == len(after)


def test_components_in_blocks_and_rounds(spark, monkeypatch):
    """Chains, hubs, loops, repeats and null ends give the same roots in one block and over star rounds."""
    from fraglens.llm import components

    edges = [(i, i + 1) for i in range(1000, 1120)] + [(2000, 2000 + i) for i in range(150)] + [(i * 37 % 400, i * 91 % 400) for i in range(260)] + [(None, 3), (7, None), (5, 5), (1000, 1001)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    want = {(x, top(x)) for x in list(up) if top(x) != x}
    df = spark.createDataFrame(edges, "u long, v long")
    assert {tuple(x) for x in components.connected_components(df).collect()} == want
    monkeypatch.setattr(components, "BLOCK", 64)
    assert {tuple(x) for x in components.connected_components(df).collect()} == want
    assert components.connected_components(df.limit(0)).count() == 0


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i)) for i in range(files.size()) if "shuffle_" in str(files.apply(i))}


def test_shuffle_files_go_when_a_step_is_written(spark):
    import time

    from fraglens.llm.common import CLEANUP, materialise

    before, held = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
    done = materialise(spark.range(1000).repartition(5, "id").groupBy("id").count())
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and done.count() == 1000 and spark.conf.get(CLEANUP, None) == held


def test_bitmaps_tell_long_texts_apart():
    from fraglens.llm import simhash

    rng = np.random.default_rng(5)
    own = lambda n: np.unique(rng.integers(-(2**62), 2**62, n))
    for n, m in ((1, 1), (900, 1100), (3000, 3000), (5000, 4100), (9000, 9000), (20000, 17000)):
        for share in (0.0, 0.5, 0.9, 1.0):
            a = own(n)
            b = np.unique(np.concatenate([a[: int(share * min(n, m))], own(m - int(share * min(n, m)))])) if m > share * min(n, m) else a[:m]
            differ = int(simhash._differ([simhash._bitmap(a)], [simhash._bitmap(b)])[0])
            assert differ <= len(np.setxor1d(a, b))
            if share <= 0.5 and n > 1:
                assert differ > 0.2 / 1.8 * (len(a) + len(b))
    assert simhash._differ([], []).tolist() == []


def test_near_copies_takes_pairs_from_fingerprints_first(spark, monkeypatch):
    from fraglens.llm import simhash

    rng = random.Random(14)
    texts = [_text(rng, 200) for _ in range(30)]
    texts += [f"{t} {_text(rng, 1)}" for t in texts[:12]] + [f"{t} {_text(rng, 40)}" for t in texts[12:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    calls, real = [], simhash.close_neighbours

    def spy(fps, tau):
        out = real(fps, tau)
        calls.append((tau, {r.node: r.fp & (2**64 - 1) for r in fps.collect()}, {tuple(r) for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "close_neighbours", spy)
    assert {r.node: r.root for r in simhash.near_copies(docs).collect()} == _linked(texts)
    ((tau, fp, pairs),) = calls
    close = {(u, v) for u in fp for v in fp if u < v and (fp[u] ^ fp[v]).bit_count() <= tau}
    want = {int(i): f for i, f in enumerate(simhash._votes([simhash.shingles(simhash.words_of(t), 3) for t in texts]).tolist())}
    assert pairs and pairs == close and all(want[i] == f for i, f in fp.items())


def test_workers_give_memory_back():
    from fraglens.llm.common import slim

    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    pins = []

    def run(batches):
        held = []
        for b in batches:
            for _ in range(2000):
                held.append(np.ones(12_000))
                pins.append(np.ones(64))
            yield b
        held.clear()

    grown = []
    for f in (run, slim(run)):
        before = resident()
        assert list(f(iter([1, 2]))) == [1, 2]
        grown.append(resident() - before)
    assert grown[1] < -100_000_000 or grown[1] < grown[0] / 2


def test_repeats_are_found_in_steps_that_leave_no_shuffle_files(spark, docs):
    import time

    from fraglens.llm import suffix_dedup

    before = _shuffle_files(spark)
    keyed = docs.selectExpr("unhex(md5(coalesce(text, ''))) AS t", "doc_id", "coalesce(text, '') AS text")
    spans = suffix_dedup.repeated_spans(keyed, 51)
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spans.toArrow().num_rows > 0 and not _shuffle_files(spark) - before


def test_near_copies_take_few_pairs(spark, monkeypatch):
    """A group of near copies of which many share each shingle: a round takes a pair for each text at most, and none is lost."""
    from fraglens.llm import common, simhash

    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(140)]
    texts = []
    for _ in range(300):
        own = list(base)
        for k in rng.integers(0, 140, rng.integers(1, 9)):
            own[k] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(own))
    rounds = []

    def spied(df):
        out = common.materialise(df)
        if df.columns == ["u", "v"]:
            rounds.append(out.count())
        return out

    fps = spark.createDataFrame([(int(a) | int(b) << 20, k) for k, (a, b) in enumerate({tuple(x) for x in (1 << rng.integers(0, 20, (400, 2))).tolist()})], "fp long, node long")
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert simhash.close_neighbours(fps, 4).count() <= 2 * fps.count()
    monkeypatch.setattr(simhash, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(simhash, "materialise", spied)
    got = {r.node: r.root for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(simhash.shingles(simhash.words_of(t), 5)) for t in texts]
    root = list(range(300))
    for a in range(300):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert got == {k: r for k, r in enumerate(root) if root.count(r) > 1 and k != r} and len(got) > 100
    assert max(rounds[: len(rounds) // 2]) <= 600


def test_near_copies_verify_few_pairs_of_a_group(spark, monkeypatch):
    """Lists that all hold one group don't each give the pairs that join it, nor pairs that don't link, even if no neighbours come first."""
    from fraglens.llm import common, simhash

    rng = np.random.default_rng(21)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(600):
        own = list(base)
        for k in rng.integers(0, 150, rng.integers(1, 3)):
            own[k] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(own))
    rounds = []

    def spied(df):
        out = common.materialise(df)
        if df.columns == ["u", "v"]:
            rounds.append(out.count())
        return out

    monkeypatch.setattr(simhash, "CHAINS", 0)
    monkeypatch.setattr(simhash, "materialise", spied)
    got = {r.node: r.root for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == _linked(texts) and len(got) > 400
    assert sum(rounds) <= 4 * len(texts)


def test_joins_of_a_list():
    """What _joining() gives links, and joins all that the similarity joins, whatever comes first."""
    from fraglens.llm import simhash

    rng = np.random.default_rng(22)
    sets, token = [], []
    for t in range(3):
        base = rng.integers(-(2**62), 2**62, 60)
        for _ in range(40):
            own = base[rng.random(60) > 0.02 * rng.integers(0, 9)]
            sets.append(np.unique(np.concatenate([base[:1], own, rng.integers(-(2**62), 2**62, rng.integers(0, 6))])))
            token.append(t)
    n = len(sets)
    x = {"token": np.array(token), "node": np.arange(n), "size": np.array(list(map(len, sets))), "pos": np.zeros(n, dtype=np.int64), "prev": np.zeros(n, dtype=np.int64), "label": np.arange(n) // 2 * 2}
    jaccard = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    links = [(a, b) for a in range(n) for b in range(a) if token[a] == token[b] and jaccard(a, b) >= 0.8]
    same = [(a, a + 1) for a in range(0, n, 2)]
    bitmaps = np.array(list(map(simhash._bitmap, sets)), dtype=object)
    parts = lambda pairs: simhash.forest(*np.array([*same, *pairs]).T, n).tolist()
    for per_row, part in ((0, 1 << 16), (1 << 20, 1 << 16), (0, 64), (1 << 20, 64)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(simhash, "PAIRS_PER_ROW", per_row)
            m.setattr(simhash, "PART", part)
            a, b = simhash._joining(x, bitmaps, sets, 0.8)
        assert all(jaccard(i, j) >= 0.8 for i, j in zip(a, b, strict=True))
        assert parts(list(zip(a, b, strict=True))) == parts(links)
        assert len(a) == len(set(parts([]))) - len(set(parts(links)))
    kept = simhash._partnered(x, bitmaps, [np.zeros(0, dtype=np.int64)] * n, 0.8)
    assert all(kept[a] and kept[b] for a, b in links if a // 2 != b // 2)
    assert not simhash._partnered(x, bitmaps, [np.zeros(1, dtype=np.int64)] * n, 0.8).any()


def test_word_fragments_of_many_texts(monkeypatch):
    """Texts that are hashed together have the fragments that each has alone; every window is in one of them."""
    from fraglens.llm import suffix_dedup

    rng = np.random.default_rng(9)
    texts = [b"", b"a " * 9, b" b" * 10, *(b" ".join(b"%d" % k for k in rng.integers(0, 4, n)) for n in (5, 30, 9, 10, 11, 200))]
    alone = [(k, *x) for k, t in enumerate(texts) for part in suffix_dedup.word_fragments([t], 10) for x in zip(*(c.tolist() for c in part[1:]), strict=True)]
    for slab in (8, 400, 1 << 16):
        monkeypatch.setattr(suffix_dedup, "SLAB", slab)
        assert [x for part in suffix_dedup.word_fragments(texts, 10) for x in zip(*(c.tolist() for c in part), strict=True)] == alone
    for k, t in enumerate(texts):
        assert sorted(i for d, first, n, _, _ in alone if d == k for i in range(first, first + n)) == list(range(max(0, len(t.split()) - 9)))
