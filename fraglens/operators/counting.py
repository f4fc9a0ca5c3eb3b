"""Sums of rows over regions without their pairs: what lies in a bin is sorted once, and a region reads running sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglens.operators.intervals import bins_of

BIN = 4096
#: Cells of (group, region) that a task computes and emits at once.
PART = 1 << 19


def region_sums(rows: DataFrame, regions: DataFrame, sums: Sequence[str], group: str = "barcode", crossing: str | None = None, width: int = BIN) -> DataFrame:
    """(group, region_id, *sums): sums of rows (group, chrom, start, last) over regions (chrom, start, end, region_id).

    A row counts in the regions that hold its start; with crossing "all" also in those whose start lies in (start, last],
    with "ending" only if they hold its last base as well. Regions without rows are left out. The first of sums is positive.

    Regions are cut at bin borders and rows are dealt to the bins they touch, so that a bin's rows and regions suffice for its
    part of the sums. Work goes with rows and results, not with the pairs of rows and regions.
    """
    kinds = dict(rows.dtypes) | {"region_id": dict(regions.dtypes)["region_id"]}
    none = lambda c: F.lit(None).cast(kinds[c])
    long = lambda c: F.col(c).cast("long")
    left = rows.select("chrom", F.explode(bins_of(F.col("start"), F.col("last") + 1, width)).alias("bin"), F.lit(False).alias("region"), F.col(group).alias("g"), long("start").alias("a"), long("last").alias("b"), none("region_id").alias("r"), *sums)
    right = regions.where("end >= start").select("chrom", F.explode(bins_of(F.col("start"), F.col("end"), width)).alias("bin"), F.lit(True).alias("region"), none(group).alias("g"), long("start").alias("a"), long("end").alias("b"), F.col("region_id").alias("r"), *(none(c).alias(c) for c in sums))
    both = left.unionByName(right).where("chrom is not null")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, spots = [], []
        for b in batches:
            is_region = b.column("region")
            spots.append(b.filter(is_region).select(["a", "b", "r"]))
            parts.append(b.filter(pa.compute.invert(is_region)).select(["g", "a", "b", *sums]))
        x, y = pa.Table.from_batches(parts).combine_chunks(), pa.Table.from_batches(spots).combine_chunks()
        if x.num_rows and y.num_rows:
            yield from _sums(x, y, key[1].as_py() * width, width, sums, crossing)

    named = ", ".join(f"{c} {kinds[c]}" for c in sums)
    found = both.groupBy("chrom", "bin").applyInArrow(run, f"g {kinds[group]}, region_id {kinds['region_id']}, {named}")
    return found.groupBy(F.col("g").alias(group), "region_id").agg(*(F.sum(c).alias(c) for c in sums))


def _sums(rows: pa.Table, regions: pa.Table, low: int, width: int, sums: Sequence[str], crossing: str | None) -> Iterator[pa.RecordBatch]:
    """Each region's part of the sums in the bin that begins at low, a number of groups at a time."""
    regions = regions.sort_by("a")
    coded = rows.column("g").combine_chunks().dictionary_encode(null_encoding="encode")
    names, g = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    start, last = (rows.column(c).to_numpy() for c in ("a", "b"))
    s, e = (regions.column(c).to_numpy() for c in ("a", "b"))
    base = min(start.min(), s.min())
    step = max(last.max(), e.max()) - base + 2
    order = np.argsort(g * step + (start - base), kind="stable")
    at_start = (g * step + (start - base))[order]
    total = [_running(rows.column(c).to_numpy()[order]) for c in sums]
    lo, hi = np.maximum(s, low) - base, np.minimum(e, low + width) - base
    hi = np.maximum(lo, hi)
    inside = s >= low
    if crossing:
        by_last = np.argsort(g * step + (last - base), kind="stable")
        at_last = (g * step + (last - base))[by_last]
        total_last = [_running(rows.column(c).to_numpy()[by_last]) for c in sums]
    span = np.flatnonzero(inside & (e - s < (last - start).max())) if crossing == "ending" else []
    if len(span):
        ends, place = np.unique(last[order], return_inverse=True)
        wide = Spans(place, [rows.column(c).to_numpy()[order] for c in sums], len(ends))
        limit = np.searchsorted(ends, e[span])
    group_start = np.searchsorted(at_start, np.arange(len(names)) * step)
    chunk = max(1, PART // len(s))
    for first in range(0, len(names), chunk):
        key = np.arange(first, min(first + chunk, len(names)), dtype=np.int64)[:, None] * step
        a, b = np.searchsorted(at_start, key + lo), np.searchsorted(at_start, key + hi)
        value = [t[b] - t[a] for t in total]
        if crossing:
            c = np.searchsorted(at_last, key + lo)
            for v, t, u in zip(value, total, total_last, strict=True):
                v += np.where(inside, t[a] - u[c], 0).astype(v.dtype)
        if len(span):
            before = np.broadcast_to(group_start[first : first + len(key), None], (len(key), len(span)))
            for v, w in zip(value, wide.at_least(before.ravel(), a[:, span].ravel(), np.tile(limit, len(key))), strict=True):
                v[:, span] -= w.reshape(len(key), -1)
        i, k = np.nonzero(value[0] > 0)
        if len(i):
            columns = [pa.array(v[i, k]) if v.dtype != np.longdouble else pa.array(v[i, k].astype(np.float64)) for v in value]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(first + i)), regions.column("r").combine_chunks().take(pa.array(k)), *columns], ["g", "region_id", *sums])


def _running(weights: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... weights; those of fractions are kept longer than they are given back."""
    kind = np.int64 if weights.dtype.kind in "iu" else np.longdouble
    out = np.zeros(len(weights) + 1, dtype=kind)
    np.cumsum(weights, dtype=kind, out=out[1:])
    return out


class Spans:
    """Sums of weights in a stretch of places whose value (0 to kinds - 1) is at least a limit, bit by bit of the value."""

    def __init__(self, value: np.ndarray, weights: Sequence[np.ndarray], kinds: int):
        self.levels = []
        self.bits = int(kinds).bit_length()
        for bit in reversed(range(self.bits)):
            one = (value >> bit & 1).astype(bool)
            order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
            value, weights = value[order], [w[order] for w in weights]
            ones = np.zeros(len(one) + 1, dtype=np.int64)
            np.cumsum(one, out=ones[1:])
            self.levels.append((bit, ones, len(one) - ones[-1], [_running(w) for w in weights]))

    def at_least(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(low), dtype=t.dtype) for t in self.levels[0][3]]
        for bit, ones, zeros, totals in self.levels:
            up = (limit >> bit & 1).astype(bool)
            a, b = ones[low], ones[high]
            for v, t in zip(out, totals, strict=True):
                v += np.where(up, 0, t[zeros + b] - t[zeros + a])
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        for v, t in zip(out, self.levels[-1][3], strict=True):
            v += t[high] - t[low]
        return out


def window_profile(points: DataFrame, windows: DataFrame, group: str = "barcode", width: int = BIN) -> DataFrame:
    """(group, pos, n): points (group, chrom, start, n; start unique) by their place in windows (chrom, start, end, forward), mirrored unless forward.

    A window adds the counts of its bases at once where a bin is full of points, and its points one by one where it isn't.
    """
    kind = dict(points.dtypes)[group]
    left = points.select("chrom", F.floor(F.col("start") / width).cast("long").alias("bin"), F.col(group).alias("g"), F.col("start").cast("long").alias("a"), F.col("n").cast("long").alias("b"), F.lit(None).cast("boolean").alias("forward"), F.lit(False).alias("window"))
    right = windows.where("end > start").select("chrom", F.explode(bins_of(F.col("start"), F.col("end"), width)).alias("bin"), F.lit(None).cast(kind).alias("g"), F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"), "forward", F.lit(True).alias("window"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        is_window = table.column("window")
        x, w = table.filter(pa.compute.invert(is_window)).sort_by("a"), table.filter(is_window)
        if not (x.num_rows and w.num_rows):
            return
        low = key[1].as_py() * width
        coded = x.column("g").combine_chunks().dictionary_encode(null_encoding="encode")
        every, at, n = coded.indices.to_numpy(), x.column("a").to_numpy() - low, x.column("b").to_numpy()
        s, e = w.column("a").to_numpy() - low, w.column("b").to_numpy() - low
        pieces = list(zip(s.tolist(), e.tolist(), np.maximum(s, 0).tolist(), np.minimum(e, width).tolist(), w.column("forward").to_pylist(), strict=True))
        most = int((e - s).max())
        chunk = max(1, (PART << 3) // (width + most))
        for first in range(0, len(coded.dictionary), chunk):
            mine = (every >= first) & (every < first + chunk)
            g, p, m = every[mine] - first, at[mine], n[mine]
            groups = min(chunk, len(coded.dictionary) - first)
            out = np.zeros((groups, most), dtype=np.int64)
            if groups * width <= 16 * len(p):
                full = np.zeros((groups, width), dtype=np.int64)
                full[g, p] = m
                for i, j, lo, hi, forward in pieces:
                    if forward:
                        out[:, lo - i : hi - i] += full[:, lo:hi]
                    else:
                        out[:, j - hi : j - lo] += full[:, lo:hi][:, ::-1]
            else:
                for i, j, lo, hi, forward in pieces:
                    one, two = np.searchsorted(p, (lo, hi))
                    np.add.at(out, (g[one:two], p[one:two] - i if forward else j - 1 - p[one:two]), m[one:two])
            i, k = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(first + i)), pa.array(k), pa.array(out[i, k])], ["g", "pos", "n"])

    found = left.unionByName(right).where("chrom is not null").groupBy("chrom", "bin").applyInArrow(run, f"g {kind}, pos long, n long")
    return found.groupBy(F.col("g").alias(group), "pos").agg(F.sum("n").alias("n"))


def nearest_sites(regions: DataFrame, domains: DataFrame, width: int = BIN) -> DataFrame:
    """(gene, region_id, distance): the least distance of a region to the sites (chrom, start, end, tss, gene, forward) whose domain it overlaps.

    Domains of one strand lie in the same way about their sites, so that of those before, in, and behind a region the nearest
    one overlaps it if any does.
    """
    kind = dict(regions.dtypes)["region_id"]
    left = domains.where("end > start").select("chrom", F.explode(bins_of(F.col("start"), F.col("end"), width)).alias("bin"), F.col("gene").alias("gene"), "forward", F.col("tss").cast("long").alias("t"), F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"), F.lit(None).cast(kind).alias("r"))
    right = regions.where("end > start").select("chrom", F.explode(bins_of(F.col("start"), F.col("end"), width)).alias("bin"), F.lit(None).cast("string").alias("gene"), F.lit(None).cast("boolean").alias("forward"), F.lit(None).cast("long").alias("t"), F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"), F.col("region_id").alias("r"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        is_site = pa.compute.is_valid(table.column("t"))
        x, y = table.filter(is_site), table.filter(pa.compute.invert(is_site)).sort_by("a")
        if not (x.num_rows and y.num_rows):
            return
        coded = x.column("gene").combine_chunks().dictionary_encode(null_encoding="encode")
        strand = x.column("forward").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        g, t, a, b = coded.indices.to_numpy().astype(np.int64) * 2 + strand, *(x.column(c).to_numpy() for c in ("t", "a", "b"))
        s, e = y.column("a").to_numpy(), y.column("b").to_numpy()
        order = np.lexsort((t, g))
        g, t, a, b = g[order], t[order], a[order], b[order]
        base = min(t.min(), s.min())
        step = max(t.max(), e.max()) - base + 2
        at = g * step + (t - base)
        genes, far = len(coded.dictionary), np.int64(1) << 62
        chunk = max(1, PART // len(s))
        for first in range(0, genes, chunk):
            mine = np.arange(first, min(first + chunk, genes), dtype=np.int64)[:, None]
            best = np.full((len(mine), len(s)), far)
            for forward in (0, 1):
                own = mine * 2 + forward
                before = np.searchsorted(at, own * step + (s - base)) - 1
                behind = np.searchsorted(at, own * step + (e - base))
                for k in (before, behind - 1, behind):  # before the region, the last one in it (or that before again), behind it
                    i = np.clip(k, 0, len(at) - 1)
                    ok = (k >= 0) & (k < len(at)) & (g[i] == own) & (a[i] < e) & (s < b[i])
                    d = np.where((t[i] >= s) & (t[i] < e), 0, np.minimum(np.abs(s - t[i]), np.abs(e - t[i])))
                    best = np.where(ok, np.minimum(best, d), best)
            i, k = np.nonzero(best < far)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(first + i)), y.column("r").combine_chunks().take(pa.array(k)), pa.array(best[i, k])], ["gene", "region_id", "distance"])

    found = left.unionByName(right).where("chrom is not null").groupBy("chrom", "bin").applyInArrow(run, f"gene string, region_id {kind}, distance long")
    return found.groupBy("gene", "region_id").agg(F.min("distance").alias("distance"))
