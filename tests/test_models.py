"""Regressions, trees, embeddings and orders against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraglens.functions.tails import binomial_sf
from fraglens.functions.text import natural_key
from fraglens.operators import cluster, embedding, motif, network, stats
from fraglens.sources import sinks


def test_natural_order(spark):
    names = ["g10", "g2", "g02x", "a", "12", "3", "g", "g100000000000000000000000", "g99999999999999999999999"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").orderBy(natural_key("name"), "name").collect()
    assert [r.name for r in rows] == ["3", "12", "a", "g", "g2", "g02x", "g10", "g99999999999999999999999", "g100000000000000000000000"]


def test_elastic_net_is_optimal():
    rng = np.random.default_rng(1)
    x, n = rng.normal(size=(60, 4)), 60
    y = x @ [1.5, 0, -0.7, 0.05] + rng.normal(0, 0.1, n) + 3
    m = np.column_stack([np.ones(n), x, y])
    beta, fitness = network.elastic_net(m.T @ m, 0.2, 0.5)

    def loss(b):
        e = (y - y.mean()) - (x - x.mean(axis=0)) @ b
        return (e @ e) / (2 * n) + 0.1 * np.abs(b).sum() + 0.05 * (b @ b)

    assert all(loss(beta) <= loss(beta + d * np.eye(4)[k]) + 1e-12 for k in range(4) for d in (1e-4, -1e-4))
    e = (y - y.mean()) - (x - x.mean(axis=0)) @ beta
    assert fitness == pytest.approx(1 - (e @ e) / ((y - y.mean()) ** 2).sum())
    assert (network.elastic_net(m.T @ m, 0.0, 0.5, positive=True)[0] >= 0).all()


def test_regression_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(3, 40))
    rows = [(f"c{c}", k, float(values[k, c])) for k in range(3) for c in range(40)]
    m = spark.createDataFrame(rows, "cell string, id int, value double")
    edges = spark.createDataFrame([(0, 2), (1, 2)], "src int, dst int")
    want = {r.src: r.regr_score for r in network.regression_scores(edges, m, m, 0.01).collect()}
    monkeypatch.setattr(network, "PART", 7)
    got = {r.src: r.regr_score for r in network.regression_scores(edges, m, m, 0.01).collect()}
    full = np.column_stack([np.ones(40), values.T])
    assert got == pytest.approx(want) and list(want.values()) != [0, 0]
    assert got == pytest.approx(dict(enumerate(network.elastic_net(full.T @ full, 0.01, 0.5)[0])))


def test_linkage_merges_nearest():
    x = np.array([0.0, 1.0, 10.0, 11.5, 30.0])
    d = np.abs(x[:, None] - x)
    assert [(a, b, s) for a, b, _, s in cluster.linkage(d)] == [(0, 1, 2), (2, 3, 2), (5, 6, 4), (4, 7, 5)]
    assert [h for _, _, h, _ in cluster.linkage(d)] == pytest.approx([1, 1.5, np.mean([10, 11.5, 9, 10.5]), np.mean([30, 29, 20, 18.5])])
    # Ward: the height of a merge of two groups is sqrt(2 |A||B| / (|A| + |B|)) times the distance of their means
    assert [h for _, _, h, _ in cluster.linkage(d, "ward")][:3] == pytest.approx([1, 1.5, np.sqrt(2) * (10.75 - 0.5)])
    assert cluster.linkage(np.zeros((1, 1))) == []


def test_tree_of_no_groups(spark):
    assert cluster.group_tree(spark.createDataFrame([], "i string, j string, value double")).count() == 0


def test_pseudo_cells_split_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(10 * (k % 3), 0.1, 2).tolist()) for k in range(60)]
    points = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r.id: r.label for r in cluster.pseudo_cells(points, target=3, min_size=5, neighbours=8).collect()}
    assert len(got) == 60
    groups = [{got[k].split(".")[0] for k in range(60) if k % 3 == g} for g in range(3)]
    assert not (groups[0] & groups[1] or groups[1] & groups[2] or groups[0] & groups[2])


@pytest.mark.parametrize("metric", ["jaccard", "cosine", "rbf"])
def test_dense_spectral_tells_groups_apart(spark, metric):
    rng = np.random.default_rng(4)
    rows = [(f"b{c:02}", f, 1.0) for c in range(20) for f in range(60) if rng.random() < (0.6 if (f < 30) == (c < 10) else 0.1)]
    v, values = embedding.dense_spectral(spark.createDataFrame(rows, "barcode string, feature_id int, value double"), 3, metric)
    at = {r.barcode: r.v[1] for r in v.collect()}
    signs = [np.sign(at[f"b{c:02}"]) for c in range(20)]
    assert len(set(signs[:10])) == len(set(signs[10:])) == 1 and signs[0] != signs[-1]
    assert list(values) == sorted(values, reverse=True)
    with pytest.raises(ValueError):
        embedding.dense_spectral(spark.createDataFrame(rows, "barcode string, feature_id int, value double"), 3, metric, most=5)


def test_unit_components(spark):
    x = np.random.default_rng(5).normal(size=(50, 4)) * [5, 3, 1, 0.5] + 7
    rows = embedding.unit_components(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, v array<double>"), 3).orderBy("id").collect()
    got = np.array([r.v for r in rows])
    assert got.T @ got == pytest.approx(np.eye(3), abs=1e-8)
    u = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[0][:, :3]
    assert np.abs(got.T @ u) == pytest.approx(np.eye(3), abs=1e-6)


def test_strict_tail(spark):
    hits = spark.createDataFrame([(k, "m") for k in (0, 1, 2, 3, 10)], "region_id int, motif_id string")
    groups = spark.createDataFrame([("g", k) for k in range(5)], "group string, region_id int")
    background = spark.range(20).select(F.col("id").cast("int").alias("region_id"))
    p = lambda strict: motif.enrichment(hits, groups, background, strict=strict).first()["p_value"]
    assert p(False) == pytest.approx(binomial_sf(3, 5, 0.25)) and p(True) == pytest.approx(binomial_sf(4, 5, 0.25))


def test_masks_and_density(spark):
    one = spark.createDataFrame([(1, True), (2, None), (3, False)], "feature_id int, selected boolean")
    two = spark.createDataFrame([(2, True), (3, None), (4, None)], "feature_id int, selected boolean")
    assert {r.feature_id: r.selected for r in stats.mask_or(one, two).collect()} == {1: True, 2: True, 3: False, 4: False}
    cells = spark.createDataFrame([(1000, 1.2), (1100, 1.4), (400, 3.0)], "n_fragment int, tsse double")
    assert [tuple(r) for r in stats.quality_density(cells).collect()] == [(30, 2, 2)]


def test_tags_by_replicate(spark, tmp_path):
    frags = spark.createDataFrame([("chr1", 1, 50, "a", 1, None), ("chr1", 5, 500, "b", 1, None)], "chrom string, start long, end long, barcode string, count int, strand string")
    groups = spark.createDataFrame([("a", "g"), ("b", "h")], "barcode string, group string")
    replicates = spark.createDataFrame([("a", 1), ("b", 2)], "barcode string, replicate int")
    sinks.export_tags(frags, groups, str(tmp_path / "t"), replicates, most=100)
    assert [p.name for p in (tmp_path / "t").glob("group=*")] == ["group=g_1"]


def test_planted_peaks(spark):
    from fraglens.plans import catalog

    rows = catalog.QUERIES["PK_01_call_peaks"](spark, "/root/testdata/sf0.01").collect()
    spots = {(r.group, r.chrom, (r.summit - 1000) // 4900) for r in rows}
    assert len(rows) == len(spots) == 4 * 5 * 20
    assert all(r.start < 1000 + 4900 * k + 60 < r.end for r in rows for k in [(r.summit - 1000) // 4900])


def test_lsi_is_the_svd_of_tf_idf(spark):
    from fraglens.operators.matrix import idf, tf_idf

    rng = np.random.default_rng(6)
    rows = [(f"b{c}", f, float(rng.integers(1, 4))) for c in range(12) for f in range(20) if rng.random() < 0.5]
    x = spark.createDataFrame(rows, "barcode string, feature_id long, value double")
    v, values = embedding.lsi(x, 3)
    m = np.zeros((12, 20))
    for r in tf_idf(x, idf(x, "lsi")).collect():
        m[int(r.barcode[1:]), r.feature_id] = r.value
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    got = np.array([r.v for r in sorted(v.collect(), key=lambda r: int(r.barcode[1:]))])
    assert values == pytest.approx(s[:3]) and np.abs(got) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-8)


def test_library_metrics(spark):
    from fraglens import schemas
    from fraglens.operators import recipe

    rows = [("chr1", 100 + k, 150 + k, f"b{k % 4}", 1, None) for k in range(40)] + [("chr1", 9000, 9050, "b0", 1, None)]
    frags = spark.createDataFrame(rows, schemas.FRAGMENT)
    peaks = spark.createDataFrame([("chr1", 50, 200), ("chr1", 150, 250)], "chrom string, start long, end long")
    sites = spark.createDataFrame([("chr1", 120, True)], "chrom string, tss long, forward boolean")
    row = recipe.library_metrics(frags, schemas.chrom_table(spark, {"chr1": 10_000}), sites, peaks).first()
    assert (row.n_peaks, row.frac_genome_in_peaks) == (2, 0.02) and row.frac_in_peaks == pytest.approx(40 / 41)
    assert row.n_cells == 4 and row.median_fragments == 10 and row.frac_cuts_in_peaks == pytest.approx(80 / 82) and row.frac_fragments_in_cells == 1


def test_fragments_of_alignment_files(spark, tmp_path):
    import gzip
    import struct

    from fraglens.sources import convert, readers

    def read(name, flag, pos, mapq=40):
        name = name.encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name), mapq, 0, 1, flag, 4, 0, pos, 0) + name + struct.pack("<I", (4 << 4) | 0) + bytes([0x12, 0x48]) + bytes([30] * 4) + b"CBZAAA\0"
        return struct.pack("<i", len(body)) + body

    ref = struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    reads = read("x", 99, 10) + read("x", 147, 50) + read("y", 99, 10) + read("y", 147, 50) + read("z", 99, 10, 3) + read("z", 147, 70, 3)
    (tmp_path / "x.bam").write_bytes(gzip.compress(b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + ref + reads))
    convert.make_fragment_file(spark, str(tmp_path / "x.bam"), str(tmp_path / "out"), tag="CB")
    assert [(r.chrom, r.start, r.end, r.barcode, r["count"]) for r in readers.read_fragments(spark, str(tmp_path / "out")).collect()] == [("chr1", 10, 54, "AAA", 2)]
    with pytest.raises(ValueError):
        convert.make_fragment_file(spark, "x.bam", "y")
