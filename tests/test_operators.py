"""Literal expectations, properties against numpy, and round trips."""

import gzip
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from fraglens import schemas
from fraglens.functions import tails
from fraglens.operators import alignments, cluster, integrate, intervals, matrix, motif, peaks, stats
from fraglens.sources import bam, readers, sinks

FRAGS = [(0, 10), (3, 13), (5, 41), (8, 18), (15, 25), (22, 24), (23, 33), (29, 40)]


def _frags(spark, pairs=FRAGS):
    return spark.createDataFrame([("chr1", a, b, "c", 1, None) for a, b in pairs], schemas.FRAGMENT)


def test_binned_coverage(spark):
    chroms = schemas.chrom_table(spark, {"chr1": 50})
    runs = matrix.normalised_coverage(_frags(spark), 3, None, chroms).orderBy("start").collect()
    assert [r.value for r in runs] == [1, 3, 4, 3, 2, 4, 3, 2]


def test_extension_weights():
    assert intervals.extend_weights(15, 17, 2, 2) == [(13, 14, 1), (14, 18, 2), (18, 19, 1)]


def test_smoothing_equals_moving_average(spark):
    base = np.zeros(80)
    for a, b in FRAGS:
        base[a + 10 : b + 10] += 1
    frags = _frags(spark, [(a + 10, b + 10) for a, b in FRAGS])
    got = np.zeros(80)
    for r in intervals.smooth(intervals.coverage(frags), 5).collect():
        got[r.start : r.end] = r.value
    assert np.allclose(got, np.convolve(base, np.ones(5) / 5, "same"))


@pytest.mark.parametrize("step", [1, 2, 3])
def test_genome_index(spark, step):
    sizes = {"1": 13, "2": 71, "3": 100}
    index = schemas.genome_index(schemas.chrom_table(spark, sizes), step)
    rows = index.orderBy("ord").collect()
    assert [r.n_bins for r in rows] == [math.ceil(n / step) for n in sizes.values()]
    assert [r.offset for r in rows] == [0, rows[0].n_bins, rows[0].n_bins + rows[1].n_bins]
    bins = index.selectExpr("explode(sequence(offset, offset + n_bins - 1)) as bin")
    back = schemas.bin_regions(bins, index, step).collect()
    assert sum(r.end - r.start for r in back) == 184


@pytest.mark.parametrize("width", [3, 7, 50])
def test_insertions_do_not_depend_on_bins(spark, width):
    chroms = schemas.chrom_table(spark, {"chr1": 50})
    assert matrix.tile_matrix(_frags(spark), chroms, width, "insertion").agg({"value": "sum"}).first()[0] == 2 * len(FRAGS)


def test_overlap_forms(spark):
    regions = spark.createDataFrame([("chr1", 9, 14, 1), ("chr1", 12, 13, 2), ("chr1", 40, 44, 3)], schemas.REGION)
    for width in (2, 1000):
        pairs = {(r.start, r.r_region_id) for r in intervals.overlap_join(_frags(spark), regions, width).collect()}
        assert pairs == {(a, k) for a, b in FRAGS for k, (c, d) in enumerate([(9, 14), (12, 13), (40, 44)], 1) if a < d and c < b}
        semi = {r.start for r in intervals.overlap_join(_frags(spark), regions, width, "left_semi").collect()}
        anti = {r.start for r in intervals.overlap_join(_frags(spark), regions, width, "left_anti").collect()}
        assert semi == {a for a, _ in pairs} and anti == {a for a, _ in FRAGS} - semi


def test_ratio_packing(spark):
    df = spark.createDataFrame([(3, 4), (3, 0), (0, 0), (0, 4)], "methyl int, total int")
    assert [r[0] for r in df.select(matrix.base_value("fraction")).collect()] == [0.75, 1.0, 0.0, 0.0]


def test_greedy_merge(spark):
    rows = [("g", "chr1", a, a + 100, a + 50, p) for a, p in ((100, 5.0), (150, 9.0), (230, 4.0), (500, 1.0))]
    chroms = schemas.chrom_table(spark, {"chr1": 1000})
    merged, member = peaks.merge_peaks(spark.createDataFrame(rows, "group string, chrom string, start long, end long, summit long, p_value double"), chroms, 50)
    assert sorted((r.start, r.end) for r in merged.collect()) == [(150, 251), (500, 601)]
    assert all(r.g for r in member.collect())


@settings(max_examples=5, deadline=None)
@given(some.lists(some.lists(some.integers(0, 3), min_size=4, max_size=4), min_size=2, max_size=5))
def test_similarities(spark, rows):
    m = np.array(rows, dtype=float)
    df = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "row int, column int, value double")
    b = m != 0
    for r in stats.jaccard(df).collect():
        assert math.isclose(r.value, (b[r.i] & b[r.j]).sum() / (b[r.i] | b[r.j]).sum())
    for r in stats.cosine(df).collect():
        assert math.isclose(r.value, m[r.i] @ m[r.j] / np.linalg.norm(m[r.i]) / np.linalg.norm(m[r.j]), abs_tol=1e-12)


def test_tails():
    assert math.isclose(tails.binomial_sf(2, 5, 0.3), sum(math.comb(5, i) * 0.3**i * 0.7 ** (5 - i) for i in range(3, 6)))
    assert math.isclose(tails.hypergeometric_sf(1, 20, 7, 12), sum(math.comb(7, i) * math.comb(13, 12 - i) for i in range(2, 8)) / math.comb(20, 12))
    assert math.isclose(tails.chi2_1_sf(3.841458820694124), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.poisson_sf(3, 2.0), 1 - math.exp(-2) * (1 + 2 + 2))


def test_motif_threshold():
    m = motif.Motif("m", ((0.7, 0.1, 0.1, 0.1),) * 4)
    limit = motif.threshold(m, 0.01)
    words = ["".join(x) for x in __import__("itertools").product("ACGT", repeat=4)]
    hits = sum(motif.scores(m, w)[0] >= limit for w in words)
    assert hits / len(words) <= 0.01 and hits > 0
    assert motif.reverse_complement("AACGN") == "NCGTT"


def test_communities():
    i = [a + 5 * g for g in range(3) for a in range(5) for b in range(a)] + [0, 5]
    j = [b + 5 * g for g in range(3) for a in range(5) for b in range(a)] + [5, 10]
    label = cluster.louvain(15, np.array(i), np.array(j), np.ones(len(i)))
    assert len(set(label)) == 3 and all(len(set(label[5 * g : 5 * g + 5])) == 1 for g in range(3))


def test_density_clusters():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.1, (20, 2)), rng.normal(3, 0.1, (20, 2))])
    label = cluster.hdbscan(x)
    assert len(set(label[:20]) - {-1}) == 1 and set(label[:20]) - {-1} != set(label[20:]) - {-1}


def test_cell_calling():
    counts = np.concatenate([np.full(100, 1000), np.full(5000, 3)])
    assert integrate.call_cells(counts, bootstraps=10) in range(95, 111)


def test_duplicates_collapse(spark):
    rows = [("a:1", 99, 60, "chr1", 100, "50M", 10), ("a:1", 147, 60, "chr1", 250, "50M", 10), ("a:2", 99, 60, "chr1", 105, "5S45M", 90), ("a:2", 147, 60, "chr1", 250, "50M", 5), ("a:3", 99, 60, "chr1", 400, "50M", 5)]
    reads = spark.createDataFrame(rows, "name string, flag int, mapq int, chrom string, pos long, cigar string, quality long")
    got = alignments.fragments_paired(alignments.usable(alignments.with_barcode(reads, "^(a):"))).collect()
    assert [(r.start, r.end, r["count"]) for r in got] == [(100, 300, 2)]


def test_fragment_files(spark, tmp_path):
    path = str(tmp_path / "f")
    sinks.write_fragments(_frags(spark), path)
    got = readers.read_fragments(spark, path)
    assert sorted((r.start, r.end, r["count"]) for r in got.collect()) == sorted((a, b, 1) for a, b in FRAGS)
    groups = spark.createDataFrame([("c", "x/y")], "barcode string, group string")
    sinks.export_fragments(_frags(spark), groups, str(tmp_path / "g"))
    assert (tmp_path / "g" / "group=x+y").is_dir()


def test_annotation_and_motif_files(spark, tmp_path):
    gtf = tmp_path / "a.gtf"
    gtf.write_text('#x\nchr1\ts\ttranscript\t10\t90\t.\t-\t.\tgene_id "g1"; transcript_id "t1"; gene_name "A;B"; transcript_type "protein_coding";\nchr1\ts\texon\t1\t2\t.\t+\t.\tgene_id "g1";\n')
    rows = readers.read_annotation(spark, str(gtf)).collect()
    assert [(r.tx_id, r.gene, r.left, r.is_coding) for r in rows] == [("t1", "A;B", 10, True)]
    meme = "MEME version 4\n\nMOTIF M1 n1\nletter-probability matrix: alength= 4 w= 2 nsites= 1\n 0.1 0.2 0.3 0.4\n1 0 0 0\n"
    assert [(m.id, m.name, len(m.pwm)) for m in readers.parse_meme(meme)] == [("M1", "n1", 2)]
    fasta = tmp_path / "g.fa"
    fasta.write_text(">chr1 x\nACGTACGT\nAC\n>chr2\nTTTT\n")
    seqs = readers.read_fasta(spark, str(fasta), 4)
    regions = spark.createDataFrame([(1, "chr1", 2, 9), (2, "chr2", 0, 4), (3, "chr2", 2, 6)], "region_id int, chrom string, start long, end long")
    assert {r.region_id: r.seq for r in readers.fetch(regions, seqs, 4).collect()} == {1: "GTACGTA", 2: "TTTT", 3: None}


def test_alignment_files(spark, tmp_path):
    name, cigar, qual = b"bc:1\0", [(50 << 4) | 0], bytes([30] * 4)
    body = struct.pack("<iiBBHHHiiii", 0, 99, len(name), 40, 0, len(cigar), 99, 4, 0, 200, 0) + name + struct.pack("<I", *cigar) + bytes([0x12, 0x48]) + qual + b"CBZAAA\0NMC\1"
    ref = struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    path = tmp_path / "x.bam"
    path.write_bytes(gzip.compress(b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + ref + struct.pack("<i", len(body)) + body))
    spark.dataSource.register(bam.BamSource)
    row = spark.read.format("bam").load(str(path)).first()
    assert (row.name, row.flag, row.mapq, row.chrom, row.pos, row.cigar, row.quality, row.seq, row.tags["CB"]) == ("bc:1", 99, 40, "chr1", 99, "50M", 120, "ACGT", "AAA")


def test_stream_of_tiles(spark, tmp_path):
    from fraglens.streaming.tiles import fragment_stream, tile_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("".join(f"chr1\t{a}\t{b}\tc\t1\n" for a, b in FRAGS))
    chroms = schemas.chrom_table(spark, {"chr1": 50})
    stream = tile_counts(fragment_stream(spark, str(tmp_path / "in")), chroms, 10).writeStream.outputMode("complete").format("memory").queryName("tiles").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    want = {(r.tile, r.value) for r in matrix.tile_matrix(_frags(spark), chroms, 10).collect()}
    assert {(r.tile, r.value) for r in spark.table("tiles").collect()} == want
