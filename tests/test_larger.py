"""Queries and operators on tables that the smallest ones don't hold."""

import os

import duckdb
import numpy as np
import pytest

from fraglens.plans import catalog

SF = "/root/testdata/sf0.001"


def _same(spark, name: str, folder, tables: str) -> None:
    db = duckdb.connect()
    for t in tables.split():
        db.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    a, b = catalog.QUERIES[name](spark, str(folder)).toPandas(), db.execute(catalog.SQL[name]).df()
    cols = sorted(a.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True).astype(str)
    assert cols == sorted(b.columns) and order(a).equals(order(b))


def test_edge_stats_of_large_keys(spark, tmp_path):
    spark.createDataFrame([(k, float(q)) for k, q in ((50, 1), (400, 2), (2000, 3), (20_000, 4), (20_001, 5), (900_000, 7))], "l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet/")
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = sorted(db.execute(catalog.SQL["NW_09_edge_stats"]).fetchall())
    assert sorted(tuple(x) for x in catalog.QUERIES["NW_09_edge_stats"](spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("strategy", ["insertion", "fragment", "paired-insertion"])
def test_region_matrix_against_pairs(spark, strategy):
    """Fragments longer than a region, regions over several bins, single ends, equal rows and one base regions; bins of 50 bases."""
    from fraglens import schemas
    from fraglens.operators import matrix

    rng = np.random.default_rng(1)
    frags = [("chr%d" % rng.integers(1, 3), int(a), int(a + rng.integers(1, 200)), "c%d" % rng.integers(3), 1, [None, None, "+", "-"][rng.integers(4)]) for a in rng.integers(0, 600, 300)]
    frags += frags[:40]
    regions = [("chr%d" % rng.integers(1, 3), int(a), int(a + rng.integers(1, 170)), k) for k, a in enumerate(rng.integers(0, 700, 80))]
    want: dict[tuple[str, int], int] = {}
    for c, a, b, cell, _, strand in frags:
        for d, s, e, k in regions:
            ends = [a, b - 1] if strand is None else [a] if strand == "+" else [b - 1]
            hits = [s <= p < e for p in ends]
            n = sum(hits) if strategy == "insertion" or strand else int(a < e and s < b) if strategy == "fragment" else int(any(hits))
            if c == d and n:
                want[cell, k] = want.get((cell, k), 0) + n
    for width in (50, 4096):
        got = matrix.region_matrix(spark.createDataFrame(frags, schemas.FRAGMENT), spark.createDataFrame(regions, schemas.REGION), strategy, width=width)
        assert {(r.barcode, r.region_id): r.value for r in got.collect()} == want


@pytest.mark.parametrize("name", ["J_01_02_overlap_fragment", "J_03_AGG_08_insertion", "J_04_AGG_08_paired_insertion", "AGG_11_gene_matrix", "AGG_12_value_regions"])
def test_region_counts_make_no_pairs(spark, name):
    """No join of fragments and regions on a bin, whose rows are their pairs."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "r_start" not in plan and "r_chrom" not in plan


@pytest.mark.parametrize("cells", [1, 300])
def test_tss_windows_against_pairs(spark, cells):
    """Windows cut at base 0, equal sites on both strands, cells with few and with many insertions."""
    from fraglens import schemas
    from fraglens.operators import fragments

    rng = np.random.default_rng(2)
    frags = [("chr1", int(a), int(a + rng.integers(1, 300)), f"c{rng.integers(cells)}", 1, None) for a in rng.integers(0, 9000, 3000)]
    sites = [("chr1", int(a), bool(f)) for a in {5, 1500, *rng.integers(0, 9000, 20).tolist()} for f in (True, False)]
    want: dict[tuple[str, int], int] = {}
    score = {f[3]: [0, 0] for f in frags}
    for _, tss, forward in sites:
        low, high = max(0, tss - 2000), tss + 2001
        for _, a, b, cell, _, _ in frags:
            for p in (a, b - 1):
                if low <= p < high:
                    at = p - low if forward else high - 1 - p
                    want[cell, at] = want.get((cell, at), 0) + 1
                    score[cell][0] += 1995 <= at <= 2005
                    score[cell][1] += at < 100 or at > 3900
    f, s = spark.createDataFrame(frags, schemas.FRAGMENT), spark.createDataFrame(sites, "chrom string, tss long, forward boolean")
    assert {(r.barcode, r.pos): r.n for r in fragments.tss_hits(f, s).collect()} == want
    assert {r.barcode: r.tsse for r in fragments.tsse(f, s).collect()} == {c: x / 11 / (y / 200 + 0.1) for c, (x, y) in score.items()}


@pytest.mark.parametrize("name", ["W_01_02_tss_profile", "AGG_17_W_01_tsse", "PL_02_tsse_density"])
def test_tss_windows_make_no_pairs(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "r_start" not in plan and "r_chrom" not in plan


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_semi_and_anti_group_nothing(spark, how):
    """Rows in one, two and many bins, equal rows, a null place; short rows are neither grouped nor joined back to themselves."""
    from fraglens.operators import intervals

    rng = np.random.default_rng(3)
    rows = [("chr%d" % rng.integers(1, 4), int(a), int(a + rng.integers(1, 400))) for a in rng.integers(0, 5000, 300)]
    rows += rows[:50] + [("chr1", 0, 4000), ("chr9", 5, 10), (None, 5, 10)]
    spots = [("chr%d" % rng.integers(1, 3), int(a), int(a + rng.integers(1, 60))) for a in rng.integers(0, 5000, 40)]
    hit = lambda r: any(r[0] == c and r[1] < e and s < r[2] for c, s, e in spots)
    frame = lambda x: spark.createDataFrame(x, "chrom string, start long, end long")
    for width in (100, 1000):
        got = intervals.overlap_join(frame(rows), frame(spots), width, how)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in rows if hit(r) == (how == "left_semi"))
    name = {"left_semi": "AGG_15_frip", "left_anti": "J_06_FLT_11_anti"}[how]
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    if how == "left_semi":
        assert "_h_start" not in plan and "Aggregate [barcode#" in plan and "start#" not in " ".join(x for x in plan.splitlines() if "Aggregate [barcode" in x)
    else:
        assert "LeftAnti" in plan


def test_products_by_block(spark, monkeypatch):
    """Several blocks and stretches of columns, absent values, rows without spread."""
    import math

    from fraglens.operators import products, stats

    for name, n in (("BLOCK", 8), ("COLUMNS", 3), ("EMIT", 2)):
        monkeypatch.setattr(products, name, n)
    rng = np.random.default_rng(4)
    for share in (1.0, 0.4):
        m = np.where(rng.random((20, 7)) < share, np.round(rng.random((20, 7)), 3) + 5, np.nan)
        m[3] = 2.0
        df = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(20) for j in range(7) if not np.isnan(m[i, j])], "row int, column int, value double")
        both = {(i, j): ~np.isnan(m[i]) & ~np.isnan(m[j]) for i in range(20) for j in range(20)}
        z = np.nan_to_num(m)
        norm = np.linalg.norm(z, axis=1)
        got = {(r.i, r.j): r.value for r in stats.cosine(df).collect()}
        assert got.keys() == {k for k, b in both.items() if b.any()} and all(math.isclose(v, z[i] @ z[j] / norm[i] / norm[j]) for (i, j), v in got.items())
        got = {(r.i, r.j): r.value for r in stats.pearson(df).collect()}
        assert got.keys() == {k for k, b in both.items() if b.any()}
        for (i, j), v in got.items():
            x, y = m[i][both[i, j]], m[j][both[i, j]]
            flat = len(set(x)) < 2 or len(set(y)) < 2
            assert v is None if flat else math.isclose(v, np.corrcoef(x, y)[0, 1], abs_tol=1e-9)
        if share == 1.0:
            got = {(r.i, r.j): r.value for r in stats.chebyshev(df).collect()}
            assert len(got) == 400 and all(v == np.abs(m[i] - m[j]).max() for (i, j), v in got.items())


@pytest.mark.parametrize("name", ["LA_01_jaccard", "LA_02_cosine", "LA_03_06_pearson", "LA_04_spearman", "LA_05_pairwise"])
def test_similarities_dont_join_by_column(spark, name):
    """A join by column makes a row for each pair and column."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join Inner, (column" in line for line in plan.splitlines())


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_keeps_ties_by_id(spark, monkeypatch, metric):
    """Thirty equal points: more ties than the eight that a block kept beyond k before; several blocks."""
    from fraglens.operators import neighbors

    monkeypatch.setattr(neighbors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    v = np.vstack([np.tile([0.6, 0.8, 0.1], (30, 1)), rng.random((20, 3))])
    ids = rng.permutation(1000)[:50]
    got = neighbors.knn(spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>"), 4, metric).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = lambda a, b: 1 - (u[a] * u[b]).sum() if metric == "cosine" else np.linalg.norm(v[a] - v[b])
    want = {(int(ids[a]), r + 1): (int(j), d) for a in range(50) for r, (d, j) in enumerate(sorted((round(far(a, b), 12), int(ids[b])) for b in range(50) if b != a)[:4])}
    assert {(r.i, r["rank"]): r.j for r in got} == {k: x[0] for k, x in want.items()}
    assert all(abs(r.dist - want[r.i, r["rank"]][1]) < 1e-9 for r in got)


@pytest.mark.parametrize("up, down", [(300, 40), (0, 90), (120, 0)])
def test_links_against_pairs(spark, up, down):
    """Uneven domains on both strands, genes in two spellings, sites near base 0 and in regions."""
    from fraglens.operators import network

    rng = np.random.default_rng(6)
    tx = [(["g1", "G1", "g2", "g3"][rng.integers(4)], "chr1", int(a), int(a + rng.integers(1, 400)), "+-"[rng.integers(2)]) for a in rng.integers(1, 6000, 60)]
    regions = [("chr1", int(a), int(a + rng.integers(1, 150)), k) for k, a in enumerate(rng.integers(0, 6000, 120))]
    want: dict[tuple[str, int], int] = {}
    for gene, _, left, right, strand in tx:
        t = left - 1 if strand == "+" else right - 1
        low, high = (max(0, t - up), t + down) if strand == "+" else (max(0, t - down), t + up)
        for _, s, e, k in regions:
            if s < high and low < e and low < high:
                d = 0 if s <= t < e else min(abs(s - t), abs(e - t))
                want[gene.upper(), k] = min(d, want.get((gene.upper(), k), d))
    got = network.link_regions(spark.createDataFrame(regions, "chrom string, start long, end long, region_id long"), spark.createDataFrame(tx, "gene string, chrom string, left long, right long, strand string"), up, down)
    assert {(r.gene, r.region_id): r.distance for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_consensus_by_block(spark, monkeypatch):
    """Several blocks, a point that is absent from a run, a null label; no join of the points with each other."""
    from fraglens.operators import cluster, products

    monkeypatch.setattr(products, "BLOCK", 8)
    runs = [(r, i, (i * r) % 4) for r in (3, 5, 6) for i in range(30) if (r, i) != (5, 7)] + [(5, 30, None)]
    want: dict[tuple[int, int], float] = {}
    for r, i, a in runs:
        for q, j, b in runs:
            if r == q and a == b and a is not None:
                want[i, j] = want.get((i, j), 0) + 1 / 3
    got = cluster.consensus(spark.createDataFrame(runs, "run int, id long, label long"))
    found = {(r.i, r.j): r.m for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(v - want[k]) < 1e-12 for k, v in found.items())
    assert "Join Inner, (" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scan_takes_a_batch_at_once(spark, monkeypatch):
    """As sequence by sequence: none across borders, other letters, short and empty sequences; a motif is scored once per batch and strand."""
    from fraglens.operators import motif

    rng = np.random.default_rng(7)
    seqs = ["".join(rng.choice(list("ACGTNacgt"), rng.integers(0, 30))) for _ in range(200)]
    motifs = [motif.Motif("a", ((0.9, 0.03, 0.03, 0.04),) * 3), motif.Motif("b", ((0.05, 0.85, 0.05, 0.05),) * 4)]
    for both in (True, False):
        want = {(i, m.id) for i, x in enumerate(seqs) for m in motifs for y in ([x, motif.reverse_complement(x)] if both else [x]) if motif.scores(m, y).max(initial=-np.inf) >= motif.threshold(m, 0.02)}
        found = motif.scan(spark.createDataFrame(list(enumerate(seqs)), "region_id long, seq string"), motifs, 0.02, both).collect()
        assert {(r.region_id, r.motif_id) for r in found} == want and len(found) == len(want) > 10
    assert "for region, seq in" not in __import__("inspect").getsource(motif.scan)


@pytest.mark.parametrize("shift", [0.0, 1e-12])
def test_quantiles_are_exact(spark, shift):
    """Ties, nulls, NaN as the largest, infinities, values very near each other; no task holds every value."""
    from fraglens.operators import stats

    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(5.0, 700), rng.normal(size=900) * (shift or 1) + 3, rng.integers(0, 9, 400), [np.inf, -np.inf]])
    shares = [0.0, 0.01, 0.3, 0.5, 0.9, 0.999, 1.0]
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 20, "value double")
    assert stats.quantiles(rows, shares) == [rows.selectExpr(f"percentile(value, {q}) p").first().p for q in shares]
    assert np.isnan(stats.quantiles(rows.union(spark.createDataFrame([(float("nan"),)] * 50, "value double")), [0.99])[0])
    assert stats.quantiles(rows.where("value > 1e300 and value < 0"), shares) == [None] * 7
    plan = stats.min_max(stats.clip_quantile(rows.where("value between -9 and 9")))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "Aggregate" not in plan


def test_quantiles_of_more_values_than_the_sketch(spark):
    from fraglens.operators import stats

    rows = spark.range(200_000, numPartitions=4).selectExpr("cast(hash(id) as double) as value")
    shares = [0.01, 0.5, 0.9, 0.999]
    assert stats.quantiles(rows, shares) == list(rows.selectExpr(f"percentile(value, array({','.join(map(str, shares))})) p").first().p)


def test_approximate_neighbours_make_no_pairs(spark, monkeypatch):
    """As by a join on the buckets, but no join; blocks of few points."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from fraglens.operators import neighbors

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    points = spark.createDataFrame([(k, (centres[k % 4] + rng.normal(size=6) * 0.3).tolist()) for k in range(90)], "id long, v array<double>")
    data = points.select("id", array_to_vector("v").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.4, numHashTables=3, seed=0).fit(data)
    pairs = model.approxSimilarityJoin(data, data, 1.0, "dist").where("datasetA.id <> datasetB.id").select(F.col("datasetA.id").alias("i"), F.col("datasetB.id").alias("j"), "dist").collect()
    want = {(i, r.j): r.dist for i in range(90) for r in sorted((r for r in pairs if r.i == i), key=lambda r: (r.dist, r.j))[:5]}
    monkeypatch.setattr(neighbors, "WIDE", 40)
    got = neighbors.knn_lsh(points, 5, bucket=0.4, tables=3, reach=1.0)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.i, r.j): r.dist for r in got.collect()} == pytest.approx(want) and len({i for i, _ in want}) > 50


@pytest.mark.parametrize("kind", ["long", "string"])
def test_correlations_by_blocks(spark, monkeypatch, kind):
    """Ties, constant rows, rows that lack cells, ids without a row, an edge with a score; no row for each edge and cell."""
    from pyspark.sql import functions as F

    from fraglens.operators import network
    from fraglens.operators.stats import average_ranks

    rng = np.random.default_rng(5)
    rows = [(f"c{c}", k, float(rng.integers(0, 6)) if k else 1.0) for k in range(40) for c in range(12) if k % 7 or c % 5]
    m = spark.createDataFrame(rows, "cell string, id long, value double").withColumn("id", F.col("id").cast(kind))
    edges = spark.createDataFrame([(int(a), int(b), 9.0 if a == 3 else None) for a, b in {tuple(e) for e in rng.integers(0, 44, (300, 2)).tolist()}], "src long, dst long, cor_score double")
    edges = edges.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "cor_score")
    ranks = average_ranks(m, "id").toPandas()
    rank = {k: dict(zip(g.cell, g["rank"], strict=True)) for k, g in ranks.groupby("id")}
    monkeypatch.setattr(network, "BLOCK", 8)
    monkeypatch.setattr(network, "EDGE_VALUES", 50)
    got = network.correlation_scores(edges, m, m)
    n = 0
    for r in got.collect():
        a, b = rank.get(r.src, {}), rank.get(r.dst, {})
        x, y = (np.array([d[c] for c in sorted(a.keys() & b.keys())]) for d in (a, b))
        want = 9.0 if str(r.src) == "3" else np.corrcoef(x, y)[0, 1] if len(x) and x.std() and y.std() else None
        assert r.cor_score == (None if want is None else pytest.approx(want))
        n += want is not None
    assert n > 100 and got.count() == edges.count()
    assert " = cell#" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("part", [5, 1 << 12])
def test_regressions_by_packed_rows(spark, monkeypatch, part):
    """Children with several parents, without any, with a cell that a parent lacks; no group of cells goes to pandas."""
    from fraglens.operators import network

    rng = np.random.default_rng(6)
    values = rng.normal(size=(30, 17))
    m = spark.createDataFrame([(c, f"g{k}", float(values[k, c])) for k in range(30) for c in range(17) if (k, c) != (4, 3)], "cell int, id string, value double")
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 28, (70, 2)) if a != b}
    monkeypatch.setattr(network, "PART", part)
    scores = network.regression_scores(spark.createDataFrame([(f"g{a}", f"g{b}") for a, b in pairs] + [("g1", "none"), ("none", "g29")], "src string, dst string"), m, m, 0.01)
    assert "Pandas" not in scores._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.src, r.dst): (r.regr_score, r.fitness) for r in scores.collect()}
    assert set(got) == {(f"g{a}", f"g{b}") for a, b in pairs}
    for b in {b for _, b in pairs}:
        own = sorted((a for a, d in pairs if d == b), key=lambda a: f"g{a}")
        cells = [c for c in range(17) if c != 3 or 4 not in [*own, b]]
        full = np.column_stack([np.ones(len(cells)), values[own][:, cells].T, values[b, cells]])
        beta, fitness = network.elastic_net(full.T @ full, 0.01, 0.5)
        assert [got[f"g{a}", f"g{b}"] for a in own] == [(pytest.approx(v, abs=1e-9), pytest.approx(fitness, abs=1e-9)) for v in beta]
