"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified; the leftmost-smaller ones are sorted by an induction from their first characters, named,
and, if names repeat, sorted by recursion on the string of names (by prefix doubling if there are over MOST_BUCKETS
names, as in about any full shard); the whole array is induced from them. An induction
runs over the buckets of the alphabet, and within a bucket in waves, each of which is one array operation.
"""

from __future__ import annotations

import numpy as np

#: With more symbols than this, buckets are too small to be worth an array operation each.
MOST_BUCKETS = 512


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s (small non-negative integers) in order; a prefix comes first."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    k = int(s.max()) + 1
    if k > MOST_BUCKETS:
        return _by_doubling(s)
    smaller = _types(s)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if not len(lms):
        return _induce(s, k, smaller, lms)
    order = _induce(s, k, smaller, lms[np.argsort(s[lms], kind="stable")])
    mark = np.zeros(n, dtype=bool)
    mark[lms] = True
    by_piece = order[mark[order]]
    names = _names(s, lms, by_piece)
    at = np.empty(n, dtype=np.int32)
    at[lms] = np.arange(len(lms))
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), dtype=np.int64)
        reduced[at[by_piece]] = names
        by_piece = lms[suffix_array(reduced)]
    return _induce(s, k, smaller, by_piece)


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last is not."""
    n = len(s)
    up = np.zeros(n, dtype=bool)
    up[:-1] = s[:-1] < s[1:]
    differs = np.ones(n, dtype=bool)
    differs[:-1] = s[:-1] != s[1:]
    where = np.where(differs, np.arange(n), n - 1)
    return up[np.minimum.accumulate(where[::-1])[::-1]]


def _induce(s: np.ndarray, k: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones in order: first the larger, then the smaller."""
    n = len(s)
    size = np.bincount(s, minlength=k)
    head = np.cumsum(size) - size
    larger = np.bincount(s[~smaller], minlength=k)
    out = np.full(n, -1, dtype=np.int32)

    # symbol, plus k if the suffix is smaller; the place before the first is neither
    kind = np.append(s + k * smaller, 2 * k).astype(np.int16 if k < 2**13 else np.int32)
    narrow = np.uint8 if k <= 256 else kind.dtype

    def before(p: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes one to the left of p whose kind is in low..low + k - 1, by symbol and in the order of p; symbols; counts."""
        p = p - 1
        sym = kind[p] - low
        keep = np.flatnonzero((sym >= 0) & (sym < k))
        if not len(keep):
            return p[:0], sym[:0], size[:0]
        sym = sym[keep].astype(narrow)
        order = np.argsort(sym, kind="stable")
        return p[keep[order]], sym[order], np.bincount(sym, minlength=k)

    fill = head.copy()
    out[fill[s[n - 1]]] = n - 1
    fill[s[n - 1]] += 1
    starts = np.searchsorted(s[lms], np.arange(k + 1))

    def push(p: np.ndarray) -> None:
        p, sym, count = before(p, 0)
        if len(p):
            out[np.arange(len(p)) + (fill - np.cumsum(count) + count)[sym]] = p
            fill[:] += count

    for c in np.flatnonzero(size):
        at = head[c]
        while at < fill[c]:
            top = fill[c]
            push(out[at:top])
            at = top
        if starts[c] < starts[c + 1]:
            push(lms[starts[c] : starts[c + 1]])

    tail = head + size
    low = tail.copy()

    def pull(p: np.ndarray) -> None:
        """p: suffixes from the largest down."""
        p, sym, count = before(p, k)
        if len(p):
            out[(low - 1 + np.cumsum(count) - count)[sym] - np.arange(len(p))] = p
            low[:] -= count

    for c in np.flatnonzero(size)[::-1]:
        at = tail[c]
        while at > low[c]:
            end = low[c]
            pull(out[end:at][::-1])
            at = end
        if larger[c]:
            pull(out[head[c] : head[c] + larger[c]][::-1])
    return out


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The name of each leftmost-smaller substring in order: equal ones share it."""
    length = np.zeros(len(s), dtype=np.int32)
    length[lms] = np.append(np.diff(lms) + 1, len(s) - lms[-1])
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    same[(a == lms[-1]) | (b == lms[-1])] = False  # the last one ends with the string
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        differ = s[a[live] + step] != s[b[live] + step]
        same[live[differ]] = False
        step += 1
        live = live[~differ]
        live = live[length[a[live]] > step]
    return np.concatenate([[0], np.cumsum(~same)])


def _by_doubling(s: np.ndarray) -> np.ndarray:
    """Suffixes of a string with many symbols, by ranks of prefixes whose length doubles."""
    n = len(s)
    first = s.astype(np.int64) + 1
    step = 3 if int(first.max()) < 2**21 else 1
    for k in range(1, step):  # so many symbols at once; beyond the end there is a smaller one
        first = (first << 21) + np.append(s[k:] + 1, np.zeros(min(k, n), dtype=np.int64))[:n]
    order = np.argsort(first)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(first[order][1:] != first[order][:-1])])
    while step <= n:
        single = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(single[rank] > 1)
        if not len(open_):
            break
        after = np.zeros(len(open_), dtype=np.int64)
        inside = open_ + step < n
        after[inside] = rank[open_[inside] + step] + 1
        key = rank[open_] * (n + 1) + after
        by = np.argsort(key)  # equal keys stay one group, in any order
        key = key[by]
        # ranks are first places among all suffixes, so that those of one group stay within its range
        first = np.cumsum(single) - single
        group = rank[open_][by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
        dense = first[rank]
        dense[open_[by]] = first[group] + _carried(place, new)
        rank = dense
        step *= 2
    return np.argsort(rank)


def _carried(place: np.ndarray, new: np.ndarray) -> np.ndarray:
    """At each row, place of the last new row up to it."""
    return place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]


def permuted_lcp(data: np.ndarray, order: np.ndarray, pad: int) -> np.ndarray:
    """plcp[i]: common prefix of suffix i of data (bytes) and the suffix before it in order; 0 for the first.

    Only where the characters before the two differ is the prefix counted, eight bytes at a time; elsewhere it is
    one less than at i - 1. pad is a byte that isn't in data.
    """
    n = len(data)
    phi = np.full(n, -1, dtype=np.int32)
    phi[order[1:]] = order[:-1]
    words = np.zeros(n + 8, dtype="<u8")
    padded = np.concatenate([data, np.full(16, pad, dtype=np.uint8)])
    as_bytes = words.view(np.uint8).reshape(-1, 8)  # little-endian
    for b in range(8):
        as_bytes[:, b] = padded[b : b + n + 8]
    i = np.arange(n, dtype=np.int32)
    reducible = (i > 0) & (phi > 0)
    reducible[reducible] = data[i[reducible] - 1] == data[phi[reducible] - 1]
    start = np.flatnonzero(~reducible & (phi >= 0))
    count = np.zeros(len(start), dtype=np.int64)
    live = np.arange(len(start))
    a, b = start.copy(), phi[start].copy()
    while len(live):
        differ = words[a] ^ words[b]
        done = differ != 0
        low = differ[done] & (~differ[done] + np.uint64(1))
        count[live[done]] += (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        live, a, b = live[~done], a[~done] + 8, b[~done] + 8
        count[live] += 8
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
    plcp = np.zeros(n, dtype=np.int32)
    base = np.full(n, -1, dtype=np.int32)
    base[start] = start
    base[(~reducible) & (phi < 0)] = i[(~reducible) & (phi < 0)]
    last = np.maximum.accumulate(base)
    plcp[start] = count
    return np.maximum(plcp[last] - (i - last), 0)
