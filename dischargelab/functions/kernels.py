"""Small NumPy helpers that run inside Arrow tasks on bounded inputs."""

from __future__ import annotations

import numpy as np

ROUNDS = 12  # vectorized rounds before the rest is settled one by one


def window_bounds(t: np.ndarray, group: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (group, t): [lo, hi) of same-group rows with ``abs(dt) < radius``.

    A search on times laid out group after group comes within a few rows. The bounds are settled on
    differences, the comparison the rule is stated in, because ``t - radius`` may round differently
    from ``t[i] - t[j]``.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    first, last = np.searchsorted(group, group, side="left"), np.searchsorted(group, group, side="right")
    at = group * (t.max() - t.min() + 4 * radius) + (t - t.min())
    lo = np.clip(np.searchsorted(at, at - radius), first, np.arange(n))
    hi = np.clip(np.searchsorted(at, at + radius), np.arange(n) + 1, last)
    while (more := (lo > first) & (t - t[np.maximum(lo - 1, 0)] < radius)).any():
        lo = lo - more
    while (less := t - t[lo] >= radius).any():
        lo = lo + less
    while (more := (hi < last) & (t[np.minimum(hi, n - 1)] - t < radius)).any():
        hi = hi + more
    while (less := (hi - 1 > np.arange(n)) & (t[hi - 1] - t >= radius)).any():
        hi = hi - less
    return lo, hi


def _near(marked: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows within reach of a marked row."""
    edge = np.zeros(len(marked) + 1, np.int64)
    np.add.at(edge, lo[marked], 1)
    np.add.at(edge, hi[marked], -1)
    return np.cumsum(edge[:-1]) > 0


def greedy_spacing(t: np.ndarray, rank: np.ndarray, radius: float, group: np.ndarray | None = None,
                   state: np.ndarray | None = None, fixed: np.ndarray | None = None) -> np.ndarray:
    """Keep rows best-first, dropping rows closer than ``radius`` to a kept one.

    Rows are sorted by (group, t); ``rank`` is lower for rows that are visited earlier. ``state``
    holds earlier decisions (0 open, 1 kept, 2 dropped). Rows flagged ``fixed`` belong to another
    chunk: they are never decided here, and an open one blocks every worse row within reach, which
    then stays open. Returns the new state.

    In a round all rows that are the best open ones within their reach are kept at once, as no
    better row can drop them any more. Long descents, which give few such rows, are left to a loop.
    """
    n = len(t)
    group = np.zeros(n, dtype=np.int64) if group is None else group
    state = np.zeros(n, dtype=np.int8) if state is None else state.astype(np.int8).copy()
    fixed = np.zeros(n, dtype=bool) if fixed is None else fixed
    if not n:
        return state
    lo, hi = window_bounds(t, group, radius)
    state[_near(state == 1, lo, hi) & (state == 0) & ~fixed] = 2
    spans = np.stack([lo, hi], axis=1).ravel()
    for _ in range(ROUNDS):
        open_rank = np.append(np.where(state == 0, rank, np.iinfo(np.int64).max), np.iinfo(np.int64).max)
        best = np.minimum.reduceat(open_rank, spans)[::2]
        won = (state == 0) & ~fixed & (best == rank)
        if not won.any():
            return state  # nothing is left but rows that another chunk's open rows block
        state[won] = 1
        state[_near(won, lo, hi) & (state == 0) & ~fixed] = 2
    left = np.flatnonzero(state == 0)
    blocked = np.zeros(n, dtype=bool)
    for i in left[np.argsort(rank[left], kind="stable")]:
        if state[i] != 0:
            continue
        span = slice(lo[i], hi[i])
        if fixed[i] or blocked[i]:
            blocked[span] = True
            continue
        part = state[span]
        part[(part == 0) & ~fixed[span]] = 2
        state[i] = 1
    return state
