"""Order statistics of index ranges, for many ranges at once."""

from __future__ import annotations

import numpy as np


class RangeSelect:
    """k-th smallest value of index ranges: a wavelet matrix over the ranks of ``values``.

    Built in n log n; a query costs log n steps, and all queries take each step together.
    """

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        rank = np.empty(len(values), dtype=np.int64)
        rank[order] = np.arange(len(values))
        self.levels = []
        for b in reversed(range(max(1, (len(values) - 1).bit_length()))):
            one = (rank >> b) & 1 == 1
            self.levels.append((b, np.concatenate([[0], np.cumsum(~one)])))
            rank = np.concatenate([rank[~one], rank[one]])

    def kth(self, ranges: list[tuple[np.ndarray, np.ndarray]], k: np.ndarray) -> np.ndarray:
        """The k-th (from zero) of the union of disjoint ranges [lo, hi); anything where there are not so many."""
        at, k = np.zeros(len(k), dtype=np.int64), k.copy()
        for b, zeros in self.levels:
            low = [(zeros[lo], zeros[hi]) for lo, hi in ranges]
            n = sum(h - l for l, h in low)
            one = k >= n
            k = np.where(one, k - n, k)
            at |= one.astype(np.int64) << b
            ranges = [(np.where(one, zeros[-1] + lo - l, l), np.where(one, zeros[-1] + hi - h, h))
                      for (lo, hi), (l, h) in zip(ranges, low)]
        return self.sorted[np.minimum(at, len(self.sorted) - 1)]


def first_where(holds, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Per query the first position of [lo, hi) where ``holds`` is true (hi if none); it must stay true from there on."""
    while (lo < hi).any():
        live = lo < hi
        mid = (lo + hi) // 2
        ok = holds(np.where(live, mid, 0))
        hi, lo = np.where(live & ok, mid, hi), np.where(live & ~ok, mid + 1, lo)
    return lo


def rate_departure(train: np.ndarray, ts: np.ndarray, member: np.ndarray, window: float,
                   first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """|rate at the nearest other discharge - rate at the median gap| of a sorted train, within ``window`` of each time.

    A time that is a member of the train is left out of it: its two gaps become one. Fewer than two discharges give zero.
    Several trains may lie end to end in ``train``; [first, last) then bounds the one that a time is held against.
    """
    out = np.zeros(len(ts))
    if len(train) < 2 or not len(ts):
        return out
    first = np.zeros(len(ts), dtype=np.int64) if first is None else first
    last = np.full(len(ts), len(train), dtype=np.int64) if last is None else last
    lo = first_where(lambda m: ts - train[m] <= window, first, last)
    hi = first_where(lambda m: train[m] - ts > window, lo, last)
    use = np.flatnonzero(hi - lo - member >= 2)
    if not len(use):
        return out
    t, lo, hi, own = ts[use], lo[use], hi[use], member[use]
    at, top = first_where(lambda m: train[m] >= t, lo, hi), len(train) - 1
    before, after = at - 1, at + own
    isi = np.minimum(np.where(before >= lo, t - train[np.maximum(before, 0)], np.inf),
                     np.where(after < hi, train[np.minimum(after, top)] - t, np.inf))
    end = hi - 1
    parts = [(lo, np.where(own, np.maximum(at - 1, lo), end)), (np.where(own, np.minimum(at + 1, end), 0), np.where(own, end, 0))]
    size = sum(h - l for l, h in parts)
    joined = own & (at > lo) & (at < end)
    gap = np.where(joined, train[np.minimum(at + 1, top)] - train[np.maximum(at - 1, 0)], 0.0)
    pick = RangeSelect(np.diff(train))

    def ordered(k):
        here = pick.kth(parts, k)
        below = np.where(k > 0, pick.kth(parts, np.maximum(k - 1, 0)), -np.inf)
        return np.where(joined, np.maximum(below, np.minimum(gap, np.where(k < size, here, np.inf))), here)

    n = size + joined
    mid = (ordered((n - 1) // 2) + ordered(n // 2)) / 2
    inverse = lambda v: np.divide(1.0, v, out=np.zeros(len(v)), where=v > 0)
    out[use] = np.abs(inverse(isi) - inverse(mid))
    return out
