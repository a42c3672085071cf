"""Gap-statistic tests of whether a pool of waveforms is one cluster or two, and the merges and
splits decided by them.

All pools of a decision are tested together. Per-type moments (one aggregation) give the principal
axes of every pool, because the moments of a pair are the sum of its types' moments. Reference
points are computed from a hash of (spike, reference, axis), so every pass over the data sees the
same ones without storing them, and k-means for all pools, references and starts advances with one
pass per iteration. The driver handles only per-pool numbers. As references need no more of a spike than its hash,
tasks share the references instead where all hashes are few bytes: a task holds them and makes every pass of its reference.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dischargelab.operators.fits import PACK_ROWS, held, packed, pass_sums, seed_rows
from dischargelab.session import broadcast_bytes, materialize

N_REFS, VAR_FRAC, MAX_PC, MIN_POOL, SEED, TINY = 50, 0.90, 10, 10, 42, 1e-12
STARTS, MAX_PASSES = 10, 300
SAME = 1e-9  # centers of starts that met differ by rounding only
WARM_ROWS = 300  # rows per type on which centers settle first; they then converge on all rows


@dataclass
class Pool:
    members: tuple[int, ...]
    n: float
    mean: np.ndarray
    axes: np.ndarray            # length x n_pc
    spread: np.ndarray          # standard deviation along each axis
    within1: float              # k=1 dispersion in the reduced space
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers from 64-bit mixing of (id, salt)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / float(1 << 53)


def _ids(df: DataFrame, sid: str) -> DataFrame:
    """(g, x): the label as group, and 52 hashed bits of the spike id, which a double holds, as leading element."""
    key = F.shiftrightunsigned(F.xxhash64(sid), 12).cast("double")
    return df.select(F.col("label").cast("int").alias("g"), F.concat(F.array(key), "x").alias("x"))


def type_moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per type: count, sum and outer-product sum, flattened."""
    def fn(groups):
        for g, x in groups:
            x = x[:, 1:]
            yield g, np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    return pass_sums(rows, fn)


def _split(a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    d = int(round((-1 + np.sqrt(1 + 4 * (len(a) - 1))) / 2))
    return a[0], a[1:1 + d], a[1 + d:].reshape(d, d)


def make_pool(members: tuple[int, ...], moments: dict[int, np.ndarray]) -> Pool:
    n, s, ss = _split(sum(moments[m] for m in members))
    mean = s / n
    scatter = ss - np.outer(s, s) / n
    val, vec = np.linalg.eigh(scatter)
    val, vec = np.maximum(val[::-1], 0.0), vec[:, ::-1]
    rank = int(min(n, len(val)))
    cum = np.cumsum(val[:rank]) / max(val[:rank].sum(), TINY)
    n_pc = int(np.clip(np.searchsorted(cum, VAR_FRAC) + 1, 2, min(MAX_PC, rank)))
    return Pool(members, n, mean, vec[:, :n_pc], np.sqrt(val[:n_pc] / n), float(val[:n_pc].sum()))


def _boxes(rows: DataFrame, pools: list[Pool]) -> None:
    of: dict[int, list[int]] = {}
    for i, p in enumerate(pools):
        for m in p.members:
            of.setdefault(m, []).append(i)

    def fn(groups):
        for g, x in groups:
            for i in of.get(g, ()):
                y = (x[:, 1:] - pools[i].mean) @ pools[i].axes
                yield i, np.concatenate([y.max(0), (-y).max(0)])

    for i, a in pass_sums(rows, _maxed(fn), "max").items():
        k = len(a) // 2
        pools[i].hi, pools[i].lo = a[:k], -a[k:]


def _maxed(fn):
    def run(groups):
        acc: dict[int, np.ndarray] = {}
        for key, a in fn(groups):
            acc[key] = np.maximum(acc[key], a) if key in acc else a
        return acc.items()

    return run


def _starting(pools: list[Pool], which: Iterable[int], sets: Iterable[int], n_refs: int, starts: int, observed: bool) -> dict:
    """Starting centers (pool, set, start) of some pools and sets. A pool's starts don't depend on the pools beside it."""
    centers, asked = {}, set(sets)
    for i in which:
        p, rng = pools[i], np.random.default_rng(SEED)
        for r in range(starts if observed else 0):
            step = np.zeros(len(p.spread))
            step[r % len(step)] = p.spread[r % len(step)] * rng.uniform(0.5, 1.5)
            if 0 in asked:
                centers[i, 0, r] = np.stack([-step, step])
        drawn = rng.uniform(p.lo, p.hi, (n_refs, starts, 2, len(p.lo)))
        centers |= {(i, b, r): drawn[b - 1, r] for b in asked - {0} for r in range(starts)}
    return centers


def _settled(data, warm: dict[int, np.ndarray], pools: list[Pool], centers: dict, n_refs: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Centers first settle on ``warm``, a bounded sample per type, so few passes over all rows remain."""
    _settle(warm, pools, centers, n_refs, starts, tol=0.0)
    return _settle(data, pools, distinct_starts(centers), n_refs, starts)


def _dispersions(rows: DataFrame, warm: dict[int, np.ndarray], pools: list[Pool], n_refs: int, starts: int,
                 observed: bool) -> tuple[np.ndarray, np.ndarray]:
    """k=1 and best k=2 dispersion per pool and data set; set 0 is the data (if ``observed``).

    Sets of which a task can hold all it needs, hashes for references and rows for the data, are dealt over tasks; the others
    advance together by passes.
    """
    everyone, sets = range(len(pools)), range(0 if observed else 1, n_refs + 1)
    if isinstance(rows, dict):
        return _settled(rows, warm, pools, _starting(pools, everyone, sets, n_refs, starts, observed), n_refs, starts)
    spark = rows.sparkSession
    one, two = np.full((len(pools), n_refs + 1), np.nan), np.full((len(pools), n_refs + 1), np.inf)
    near = {}
    if 8 * (rows.agg(F.sum("n")).first()[0] or 0) <= broadcast_bytes(spark):
        near |= dict.fromkeys(range(1, n_refs + 1), _hashes(rows))
    if observed and isinstance(blocks := held(rows, len(pools) * starts), list):
        near[0] = blocks
    far = [b for b in sets if b not in near]
    if far:
        first, second = _settled(rows, warm, pools, _starting(pools, everyone, far, n_refs, starts, observed), n_refs, starts)
        one[:, far], two[:, far] = first[:, far], second[:, far]
    cores = spark.sparkContext.defaultParallelism
    work = [(0, list(everyone[at::2 * cores])) for at in range(min(2 * cores, len(pools)))] if 0 in near else []
    work += [(b, list(everyone)) for b in range(1, n_refs + 1) if b in near]
    if not work:
        return one, two
    sent = spark.sparkContext.broadcast((near.get(0), near.get(1), warm, pools))

    def run(item):
        b, which = item
        data, hashes, warm, pools = sent.value
        first, second = _settled(hashes if b else data, warm, pools, _starting(pools, which, [b], n_refs, starts, observed), n_refs, starts)
        return b, which, first[which, b], second[which, b]

    for b, which, first, second in spark.sparkContext.parallelize(work, len(work)).map(run).collect():
        one[which, b], two[which, b] = first, second
    sent.destroy()
    return one, two


def _hashes(blocks: DataFrame) -> list[tuple[int, np.ndarray]]:
    """The hashes of all spikes by type, in blocks of rows with nothing else."""
    ids = blocks.select("g", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(
        "x", (i * (F.size("x") / F.col("n"))).cast("int")))).alias("id")).toArrow()
    g, key = ids.column("g").to_numpy(), ids.column("id").to_numpy()
    out = []
    for v in np.unique(g).tolist():
        own = np.sort(key[g == v])[:, None]
        out += [(v, own[at:at + PACK_ROWS]) for at in range(0, len(own), PACK_ROWS)]
    return out


def distinct_starts(centers: dict) -> dict:
    """One of the starts of a (pool, set) whose centers, in either order, are the same: they go on alike."""
    seen, out = {}, {}
    for (i, b, r), c in centers.items():
        c = c[np.lexsort(c.T[::-1])]
        kept = seen.setdefault((i, b), [])
        if not any(np.abs(c - k).max() <= SAME * max(np.abs(k).max(), TINY) for k in kept):
            kept.append(c)
            out[i, b, r] = centers[i, b, r]
    return out


def _settle(data, pools: list[Pool], centers: dict, n_refs: int, starts: int, max_iter: int = MAX_PASSES,
            tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Two-means of every (pool, set, start) in ``centers``, all advanced by one pass at a time.

    Reference b of a type is the same cloud of unit uniforms in all its pools, only stretched to their boxes. So all pools and starts
    of a reference are assigned together in the unit cube; a pass hands on sums per (type, reference).
    """
    of: dict[int, list[int]] = {}
    for i, p in enumerate(pools):
        for m in p.members:
            of.setdefault(m, []).append(i)
    number = {g: n for n, g in enumerate(sorted(of))}
    one = np.full((len(pools), n_refs + 1), np.nan)
    two = np.full((len(pools), n_refs + 1, starts), np.inf)
    live, sets = set(centers), n_refs + 1
    cache: dict | None = None if isinstance(data, DataFrame) else {}
    observed = len(number) * sets  # keys from here on are those of observed (type, pool)

    def unit(x, b, cache=cache):
        """Reference b of the rows x in the unit cube, and its sums."""
        if cache is not None and (id(x), b) in cache:
            return cache[id(x), b]
        ids = x[:, 0].astype(np.int64)
        u = np.stack([_uniform(ids, (b * MAX_PC + a) * 7919 + SEED) for a in range(MAX_PC)])
        found = u, u.sum(1), (u * u).sum(1)
        if cache is not None:
            cache[id(x), b] = found
        return found

    for it in range(max_iter + 1):
        todo: dict[int, dict[int, list[int]]] = {}
        for i, b, r in sorted(live):
            todo.setdefault(i, {}).setdefault(b, []).append(r)
        planes = {}  # per pool and set: normals and offsets of the planes between both centers, in the unit cube for references
        for i, p in enumerate(pools):
            for b, tries in todo.get(i, {}).items():
                c = np.stack([centers[i, b, r] for r in tries])
                normal, offset = c[:, 1] - c[:, 0], ((c[:, 1] ** 2).sum(1) - (c[:, 0] ** 2).sum(1)) / 2
                if b:
                    offset = offset - normal @ p.lo
                    normal = np.pad(normal * (p.hi - p.lo), ((0, 0), (0, MAX_PC - len(p.lo))))
                planes[i, b] = normal, offset

        def fn(groups, todo=todo, planes=planes, unit=unit):
            stacks: dict = {}
            for g, x in groups:
                if g not in stacks:
                    found: dict[int, list] = {}
                    for i in of.get(g, ()):
                        for b in todo.get(i, {}):
                            if b:
                                found.setdefault(b, []).append(planes[i, b])
                    stacks[g] = {b: tuple(np.concatenate(c) for c in zip(*v)) for b, v in found.items()}
                for b, (normal, offset) in stacks[g].items():
                    u, s, ss = unit(x, b)
                    second = (normal @ u > offset[:, None]).astype(float)
                    yield number[g] * sets + b, np.concatenate([[len(x)], s, ss, second.sum(1), (second @ u.T).ravel()])
                for i in of.get(g, ()):
                    if (i, 0) in planes:
                        normal, offset = planes[i, 0]
                        y = ((x[:, 1:] - pools[i].mean) @ pools[i].axes).T
                        second = (normal @ y > offset[:, None]).astype(float)
                        yield observed + number[g] * len(pools) + i, np.concatenate(
                            [[len(x)], y.sum(1), (y * y).sum(1), second.sum(1), (second @ y.T).ravel()])

        sums = pass_sums(data, fn)
        place: dict[tuple[int, int], int] = {}  # rows of the starts before pool i's in the sums of (type, reference)
        for i, p in enumerate(pools):
            dim = len(p.lo)
            for b, tries in todo.get(i, {}).items():
                n, s, ss, n1, s1 = 0.0, 0.0, 0.0, 0.0, 0.0
                for g in p.members:
                    key, width, at = (number[g] * sets + b, MAX_PC, place.get((g, b), 0)) if b else (observed + number[g] * len(pools) + i, dim, 0)
                    if b:
                        place[g, b] = at + len(tries)
                    if key not in sums:
                        continue
                    a = sums[key]
                    rest = a[1 + 2 * width:]
                    rows, own = len(rest) // (width + 1), slice(at, at + len(tries))
                    n, s, ss = n + a[0], s + a[1:1 + width], ss + a[1 + width:1 + 2 * width]
                    n1, s1 = n1 + rest[:rows][own], s1 + rest[rows:].reshape(rows, width)[own]
                if not n:
                    live.difference_update((i, b, r) for r in tries)
                    continue
                s, ss, s1 = s[:dim], ss[:dim], s1[:, :dim]
                if b:
                    span = p.hi - p.lo
                    ss = n * p.lo ** 2 + 2 * p.lo * span * s + span ** 2 * ss
                    s, s1 = n * p.lo + span * s, n1[:, None] * p.lo + span * s1
                sq = ss.sum()
                one[i, b] = sq - (s @ s) / n
                c, m = np.stack([centers[i, b, r] for r in tries]), np.stack([n - n1, n1], 1)
                parts = np.stack([s - s1, s1], 1)
                # The sum of squared distances follows from the sums.
                two[i, b, tries] = np.maximum(sq - 2 * (parts * c).sum((1, 2)) + (m * (c * c).sum(2)).sum(1), 0.0)
                new = np.where(m[:, :, None] > 0, parts / np.maximum(m, 1)[:, :, None], c)
                done = (((new - c) ** 2).sum((1, 2)) <= tol * max(one[i, b] / n / dim, TINY)) | (it == max_iter)
                for j, r in enumerate(tries):
                    if done[j]:
                        live.discard((i, b, r))
                    else:
                        centers[i, b, r] = new[j]
        if not live:
            break
    return one, two.min(axis=2)


def gap_statistics(waves: DataFrame, members: list[tuple[int, ...]], sid: str = "spike_id", n_refs: int = N_REFS,
                   starts: int = STARTS, within2: dict[tuple[int, ...], float] | None = None,
                   moments: dict[int, np.ndarray] | None = None, rows: DataFrame | None = None) -> list[dict]:
    """Gap(1), Gap(2) and their simulation errors for every pool of types.

    ``within2`` fixes the observed two-cluster dispersion (a given partition) instead of k-means.
    """
    rows = materialize(_ids(waves, sid)) if rows is None else rows
    blocks = packed(rows)
    moments = type_moments(blocks) if moments is None else moments
    pools = [make_pool(m, moments) for m in members]
    if not pools:
        return []
    _boxes(blocks, pools)
    warm = seed_rows(rows.withColumn("sid", F.col("x")[0].cast("long")), "sid", SEED, WARM_ROWS)
    one, two = _dispersions(blocks, warm, pools, n_refs, starts, observed=within2 is None)
    out = []
    for i, p in enumerate(pools):
        obs2 = two[i, 0] if within2 is None else within2[p.members]
        r1, r2 = np.log(one[i, 1:] + TINY), np.log(two[i, 1:] + TINY)
        f = np.sqrt(1.0 + 1.0 / n_refs)
        out.append({"members": p.members, "n": int(p.n), "n_pc": len(p.lo),
                    "gap1": float(r1.mean() - np.log(p.within1 + TINY)), "gap2": float(r2.mean() - np.log(obs2 + TINY)),
                    "s1": float(r1.std() * f), "s2": float(r2.std() * f)})
    return out


def pair_verdicts(waves: DataFrame, sid: str = "spike_id", n_refs: int = N_REFS, starts: int = STARTS,
                  owner: dict[int, object] | None = None) -> list[dict]:
    """Is each pair of types one cluster (Gap(1) >= Gap(2))? Pools below ten spikes always are.

    With ``owner``, which tells every type's pool, only types of the same pool make pairs.
    """
    rows = materialize(_ids(waves, sid))
    moments = type_moments(rows)
    types = sorted(moments)
    pairs = [(a, b) for n, a in enumerate(types) for b in types[n + 1:] if owner is None or owner[a] == owner[b]]
    small = [p for p in pairs if moments[p[0]][0] + moments[p[1]][0] < MIN_POOL]
    tested = gap_statistics(waves, [p for p in pairs if p not in set(small)], sid, n_refs, starts, moments=moments, rows=rows)
    out = [{"anchor": r["members"][0], "other": r["members"][1], "n_pool": r["n"], "one": r["gap1"] >= r["gap2"],
            "gap1": r["gap1"], "gap2": r["gap2"], "s1": r["s1"], "s2": r["s2"], "n_pc": r["n_pc"]} for r in tested]
    out += [{"anchor": a, "other": b, "n_pool": int(moments[a][0] + moments[b][0]), "one": True, "gap1": None, "gap2": None,
             "s1": None, "s2": None, "n_pc": None} for a, b in small]
    return sorted(out, key=lambda r: (r["anchor"], r["other"]))


def anchor_merge(n_types: int, one_cluster: dict[tuple[int, int], bool]) -> tuple[list[int], list[tuple[int, int, bool]]]:
    """Sequential anchors over the pair verdicts: (new id per type, tests in order).

    Each anchor takes at most the first later type that tests as one with it; a taken type is
    neither partner nor anchor again. New ids follow the anchors' order.
    """
    owner, log, taken = list(range(n_types)), [], set()
    for a in range(n_types):
        if a in taken:
            continue
        for b in range(a + 1, n_types):
            if b in taken:
                continue
            same = one_cluster[a, b]
            log.append((a, b, same))
            if same:
                owner[b] = a
                taken.add(b)
                break
    ids = {o: n for n, o in enumerate(sorted(set(owner)))}
    return [ids[o] for o in owner], log


def log_within(rows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Log of the pooled within-label sum of squares per key, over array elements."""
    long = rows.select(*keys, "label", F.posexplode(x).alias("p", "v"))
    per = long.groupBy(*keys, "label", "p").agg((F.var_pop("v") * F.count("v")).alias("ss"))
    total = per.groupBy(*keys).agg(F.sum("ss").alias("ss")) if keys else per.agg(F.sum("ss").alias("ss"))
    return total.select(*keys, F.log(F.col("ss") + TINY).alias("log_within"))
