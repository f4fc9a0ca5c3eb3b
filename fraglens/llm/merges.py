"""Merging adjacent symbols by priority, for many units at once.

A unit is a short row of symbols. Its agenda is the row of priorities of its adjacent pairs; the best pair (the
leftmost of equals) is merged, its two neighbours are priced anew, and so on until no pair can be merged. Units are
handled side by side as matrices; very long ones by a heap.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
#: Longer units go to the heap; cells in a matrix.
LONG, CELLS = 192, 1 << 20


class MergeTable:
    """pairs: (left, right) -> (priority, merged); a smaller priority is merged first."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        keys = np.fromiter(((a << 32) + b for a, b in pairs), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        both = np.fromiter((x for v in pairs.values() for x in v), dtype=np.int32, count=2 * len(pairs)).reshape(-1, 2)[order]
        self.keys = np.append(keys[order], np.int64(2**62))
        self.priority, self.merged = np.append(both[:, 0], NONE), np.append(both[:, 1], np.int32(-1))

    def price(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left.astype(np.int64) << 32) + right
        at = np.searchsorted(self.keys, want)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), at, len(self.priority) - 1).astype(np.int32)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """One unit, by a heap of pairs."""
        symbols = list(symbols)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int, int]] = []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := self.pairs.get((symbols[a], symbols[b]))):
                heapq.heappush(agenda, (found[0], a, b, symbols[a], symbols[b]))

        for i in range(n - 1):
            propose(i, i + 1)
        gone = [False] * n
        while agenda:
            _, a, b, x, y = heapq.heappop(agenda)
            if gone[a] or gone[b] or right[a] != b or symbols[a] != x or symbols[b] != y:
                continue
            symbols[a] = self.pairs[x, y][1]
            gone[b] = True
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            propose(left[a], a)
            propose(a, right[a])
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def merge(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The merged symbols of each unit as little-endian 32-bit integers.

        flat: the symbols of all units one after another (negative symbols never merge); sizes: how many each has.
        """
        out: list[bytes] = [b""] * len(sizes)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], LONG, side="right"))
        at = int(np.searchsorted(sizes[order], 0, side="right"))
        while at < short:
            low = int(sizes[order[at]])
            limit = max(4, 2 * low)
            top = min(int(np.searchsorted(sizes[order], limit, side="right")), at + max(1, CELLS // limit), short)
            self._block(flat, starts, order[at:top], sizes, out)
            at = top
        for i in order[max(at, short) :]:
            out[i] = np.asarray(self.merge_long(flat[starts[i] : starts[i] + sizes[i]].tolist()), dtype="<i4").tobytes()
        return out

    def _block(self, flat: np.ndarray, starts: np.ndarray, rows: np.ndarray, sizes: np.ndarray, out: list[bytes]) -> None:
        width = int(sizes[rows[-1]])
        own = sizes[rows]
        inside = np.arange(width) < own[:, None]
        grid = np.where(inside, flat[np.minimum(starts[rows][:, None] + np.arange(width), len(flat) - 1)], np.int32(-1)).astype(np.int32)
        ids, none = rows, len(self.priority) - 1
        price = self.price(grid[:, :-1], grid[:, 1:]) if width > 1 else np.full((len(rows), 0), none, dtype=np.int32)
        while True:
            if grid.shape[1] > 1:
                rank = self.priority[price]
                best = rank.argmin(axis=1)
                open_ = rank[np.arange(len(best)), best] < NONE
            else:
                best, open_ = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=bool)
            raw, step = np.ascontiguousarray(grid[~open_], dtype="<i4").tobytes(), 4 * grid.shape[1]
            for k, (i, n) in enumerate(zip(ids[~open_].tolist(), own[~open_].tolist(), strict=True)):
                out[i] = raw[k * step : k * step + 4 * n]
            if not open_.any():
                return
            ids, grid, price, best, own = ids[open_], grid[open_], price[open_], best[open_], own[open_] - 1
            line = np.arange(len(ids))
            grid[line, best] = self.merged[price[line, best]]
            keep = np.ones(grid.shape, dtype=bool)
            keep[line, best + 1] = False
            grid = grid[keep].reshape(len(ids), -1)
            keep = np.ones(price.shape, dtype=bool)
            keep[line, best] = False
            price = price[keep].reshape(len(ids), -1)
            has = best > 0
            price[line[has], best[has] - 1] = self.price(grid[line[has], best[has] - 1], grid[line[has], best[has]])
            has = best < grid.shape[1] - 1
            price[line[has], best[has]] = self.price(grid[line[has], best[has]], grid[line[has], best[has] + 1])
