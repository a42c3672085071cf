"""Density and spin clustering of one bounded set of points, in NumPy."""

from __future__ import annotations

import numpy as np


def union_labels(n: int, edges: np.ndarray) -> np.ndarray:
    """Component number per node, numbered by smallest member."""
    lab = np.arange(n)
    while len(edges):
        low = np.minimum(lab[edges[:, 0]], lab[edges[:, 1]])
        new = lab.copy()
        np.minimum.at(new, lab[edges[:, 0]], low)
        np.minimum.at(new, lab[edges[:, 1]], low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
        while (lab[lab] != lab).any():
            lab = lab[lab]
    return np.unique(lab, return_inverse=True)[1]


def spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, length) of a least spanning tree over mutual reachability, by Prim.

    One row of distances is held at a time, so memory is linear. Of equal edges the one of lower rows comes first, which
    makes the tree the only one: trees of parts of the rows hold what the whole tree has there.
    """
    def rank(u, v):
        return (np.minimum(u, v) << 32) + np.maximum(u, v)

    n = len(x)
    left, best, src = np.arange(1, n), np.full(max(n - 1, 0), np.inf), np.zeros(max(n - 1, 0), dtype=np.int64)
    pts, reach, cur = np.ascontiguousarray(x[1:].T), core[1:].copy(), 0
    out = []
    while len(left):
        d = np.zeros(len(left))
        for axis, v in zip(pts, x[cur]):
            d += (axis - v) ** 2
        d = np.maximum(np.maximum(np.sqrt(d), reach), core[cur])
        better = d < best
        tie = np.flatnonzero(d == best)
        better[tie[rank(left[tie], cur) < rank(left[tie], src[tie])]] = True
        best[better], src[better] = d[better], cur
        at = np.flatnonzero(best == best.min())
        at = int(at[rank(left[at], src[at]).argmin()])
        cur = int(left[at])
        out.append((src[at], cur, best[at]))
        # The last open row takes the place of the one that is done.
        left[at], best[at], src[at], reach[at] = left[-1], best[-1], src[-1], reach[-1]
        pts[:, at] = pts[:, -1]
        left, best, src, reach, pts = left[:-1], best[:-1], src[:-1], reach[:-1], pts[:, :-1]
    e = np.array(out, dtype=float).reshape(-1, 3)
    return e[:, 0].astype(np.int64), e[:, 1].astype(np.int64), e[:, 2]


def least_tree(n: int, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of the edges of a least spanning forest, shortest first; of equals, the first in (length, a, b)."""
    parent, kept = list(range(n)), []
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), length))
    for e, i, j in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[i] = j
            kept.append(e)
    return np.array(kept, dtype=np.int64)


def tree_labels(n: int, tree: list[tuple[float, int, int]], min_size: int = 5) -> np.ndarray:
    """Density clusters of a spanning tree (length, a, b) with excess-of-mass selection; -1 marks noise.

    Points at no distance from each other are never taken apart.
    """
    # Single linkage: merge edges by length; node ids n.. are merges.
    parent, size, kids, height = list(range(2 * n - 1)), [1] * n, {}, {}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for m, (h, a, b) in enumerate(sorted((h, min(a, b), max(a, b)) for h, a, b in tree), start=n):
        ra, rb = find(a), find(b)
        parent[ra] = parent[rb] = m
        kids[m], height[m] = (ra, rb), h
        size.append(size[ra] + size[rb])

    def members(node):
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack.extend(kids[v])
        return out

    # Condense: a cluster lives until it splits into two parts of at least min_size.
    clusters: list[dict] = [{"node": 2 * n - 2, "birth": 0.0, "mass": 0.0, "kids": []}]
    for c in clusters:  # grows while iterating
        node = c["node"]
        while node >= n:
            if height[node] <= 0:
                c["mass"] = np.inf
                break
            lam = 1.0 / height[node]
            a, b = kids[node]
            big = [v for v in (a, b) if size[v] >= min_size]
            if len(big) == 2:
                c["mass"] += (lam - c["birth"]) * size[node]
                for v in big:
                    c["kids"].append(len(clusters))
                    clusters.append({"node": v, "birth": lam, "mass": 0.0, "kids": []})
                break
            if not big:
                c["mass"] += (lam - c["birth"]) * size[node]
                break
            c["mass"] += (lam - c["birth"]) * (size[node] - size[big[0]])
            node = big[0]
    value = [c["mass"] for c in clusters]
    chosen = [True] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):
        below = sum(value[j] for j in clusters[i]["kids"])
        if clusters[i]["kids"] and below > value[i]:
            value[i], chosen[i] = below, False
    labels, stack = np.full(n, -1), list(clusters[0]["kids"])  # the root alone is not a cluster
    picked = 0
    while stack:
        i = stack.pop(0)
        if chosen[i]:
            labels[members(clusters[i]["node"])] = picked
            picked += 1
        else:
            stack.extend(clusters[i]["kids"])
    return labels


def hdbscan(x: np.ndarray, min_size: int = 5, min_samples: int | None = None) -> np.ndarray:
    """Density clustering of one bounded set of points; -1 marks noise."""
    k = min(min_samples or min_size, len(x))
    core = np.array([np.partition(((x - p) ** 2).sum(1), k - 1)[k - 1] ** 0.5 for p in x])
    a, b, length = spanning_tree(x, core)
    return tree_labels(len(x), list(zip(length.tolist(), a.tolist(), b.tolist())), min_size)


def potts_labels(n: int, edges: np.ndarray, weight: np.ndarray, temperature: float, q: int, steps: int,
                 seed: int) -> np.ndarray:
    """Components of edges whose end spins agree more than half of the time at one temperature."""
    rng = np.random.default_rng(seed)
    order = np.argsort(np.concatenate([edges[:, 0], edges[:, 1]]), kind="stable")
    ends = np.concatenate([edges[:, 1], edges[:, 0]])[order]
    bond = np.concatenate([weight, weight])[order]
    start = np.searchsorted(np.sort(np.concatenate([edges[:, 0], edges[:, 1]])), np.arange(n + 1))
    prob = 1.0 - np.exp(-bond / temperature)
    spins = rng.integers(0, q, n)

    def flip():
        root = rng.integers(n)
        state = spins[root]
        fresh = (state + 1 + rng.integers(q - 1)) % q
        inside = np.zeros(n, dtype=bool)
        inside[root] = True
        front = np.array([root])
        while len(front):
            idx = np.concatenate([np.arange(start[i], start[i + 1]) for i in front])
            take = idx[(spins[ends[idx]] == state) & (rng.random(len(idx)) < prob[idx])]
            grown = np.unique(ends[take])
            front = grown[~inside[grown]]
            inside[front] = True
        spins[inside] = fresh

    for _ in range(steps // 2):
        flip()
    rounds = max(1, steps - steps // 2)
    same = np.zeros(len(edges))
    for _ in range(rounds):
        flip()
        same += spins[edges[:, 0]] == spins[edges[:, 1]]
    return union_labels(n, edges[same / rounds > 0.5])
