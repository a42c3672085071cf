"""Iterative fits whose every iteration is one pass over the data.

All restarts, all cluster counts of a sweep and all groups advance together: a pass computes the
sufficient statistics of every open fit per partition, the partial sums are added on the
executors, and only (fits x clusters x dimensions) numbers reach the driver. A bounded sample is fetched
from which k-means draws its first centers; all fits then converge on all rows. Where all rows are few
bytes, tasks share the fits instead: each holds all rows and makes every pass of its fits itself, so a fit
costs one job and not one per pass.

Input rows are (``g`` int group, ``x`` array<double>).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import partial
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.session import attach, broadcast_bytes, materialize, shuffle_width

FEW_BYTES = 2 << 20  # rows of so many bytes are held by a task even where fits are fewer than cores
PACK_ROWS = 2048  # rows of a block of ``packed``
SEED_ROWS = 2000  # rows per group that seed the initial centers, or
PAIR_DIMS = 16  # up to so many dimensions the products of all pairs are laid out once for all fits
SEED_ROWS_PER_CENTER = 20  # as many for each center, if that is more


Groups = Iterable[tuple[int, np.ndarray]]
Blocks = list[tuple[int, np.ndarray]]
Stats = Callable[[Groups], Iterable[tuple[int, np.ndarray]]]


def merge_stats(parts: Iterable[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    acc: dict[int, np.ndarray] = {}
    for key, a in parts:
        acc[key] = acc[key] + a if key in acc else a
    return acc


def packed(df: DataFrame, by: str | None = None) -> DataFrame:
    """(g, n, x): rows of a group laid end to end in blocks, for fits that read them many times.

    Rows are dealt by the hash of ``by`` (of x, if there is none) over at least two partitions a core: they are few bytes but long work.
    """
    spark = df.sparkSession
    width = max(shuffle_width(spark), 2 * spark.sparkContext.defaultParallelism)
    rows = df.select(F.col("g").cast("int").alias("g"), "x", *([F.col(by).alias("_by")] if by else []))
    rows = rows.repartition(width, "_by" if by else "x").select("g", "x")

    def blocks(batches):
        held: dict[int, list[np.ndarray]] = {}

        def out(g):
            x = np.concatenate(held.pop(g))
            return pa.record_batch({"g": pa.array([g], pa.int32()), "n": pa.array([len(x)], pa.int32()), "x": pa.array([x.ravel()], pa.list_(pa.float64()))})

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1)
            for v in np.unique(g).tolist():
                own = x[g == v]
                for at in range(0, len(own), PACK_ROWS):
                    held.setdefault(v, []).append(own[at:at + PACK_ROWS])
                    if sum(map(len, held[v])) >= PACK_ROWS:
                        yield out(v)
        for v in list(held):
            yield out(v)

    return materialize(rows.mapInArrow(blocks, "g int, n int, x array<double>"))


def held(blocks: DataFrame, n_fits: int) -> DataFrame | Blocks:
    """The blocks of ``packed`` as they are or, if they are few bytes for so many fits, fetched for ``dealt``."""
    spark = blocks.sparkSession
    size = 8 * (blocks.agg(F.sum(F.size("x"))).first()[0] or 0)
    if size > (broadcast_bytes(spark) if n_fits >= 2 * spark.sparkContext.defaultParallelism else FEW_BYTES):
        return blocks
    got = blocks.toArrow()
    cols = (got.column("g").to_pylist(), got.column("n").to_pylist(), got.column("x"))
    return [(g, np.asarray(x.values).reshape(n, -1)) for g, n, x in zip(*cols, strict=True)]


def dealt(spark, data: DataFrame | Blocks, fits: list[Fit], work: Callable[[DataFrame | Blocks, list[Fit]], list[Fit]]) -> list[Fit]:
    """``work(data, fits)``. Over blocks that ``held`` has fetched, the fits are dealt to tasks, which read all blocks of their groups."""
    if isinstance(data, DataFrame) or not fits:
        return work(data, fits)
    rows: dict[int, int] = {}
    for g, x in data:
        rows[g] = rows.get(g, 0) + len(x)
    order = sorted(range(len(fits)), key=lambda i: -fits[i].k * rows.get(fits[i].g, 0))  # each task gets large and small ones
    sent, n = spark.sparkContext.broadcast(data), min(len(fits), 4 * spark.sparkContext.defaultParallelism)

    def run(part):
        own = [f for _, f in part]
        groups = {f.g for f in own}
        return [(i, f) for (i, _), f in zip(part, work([b for b in sent.value if b[0] in groups], own), strict=True)]

    parts = [[(i, fits[i]) for i in order[at::n]] for at in range(n)]
    found = dict(spark.sparkContext.parallelize(parts, n).flatMap(run).collect())
    sent.destroy()
    return [found[i] for i in range(len(fits))]


def pass_sums(data: DataFrame | dict[int, np.ndarray] | Blocks, fn: Stats, how: str = "sum") -> dict[int, np.ndarray]:
    """Add (or maximize) the per-batch arrays of ``fn`` over all rows, by integer key.

    ``data`` is the full data, as rows (g, x) or ``packed``, or what the caller holds: the bounded seed sample, or a task's blocks.
    """
    merge = np.add if how == "sum" else np.maximum
    if not isinstance(data, DataFrame):
        return merge_stats(fn(data.items() if isinstance(data, dict) else data))

    def run(batches):
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            if len(pdf):
                for key, a in fn(by_group(pdf)):
                    acc[key] = merge(acc[key], a) if key in acc else a
        if acc:
            yield pd.DataFrame({"key": list(acc), "a": list(acc.values())})

    parts = data.mapInPandas(run, "key long, a array<double>").withColumn("a", array_to_vector("a"))
    total = parts.groupBy("key").agg((Summarizer.sum if how == "sum" else Summarizer.max)(F.col("a")).alias("a"))
    return {r["key"]: r["a"].toArray() for r in total.collect()}


def by_group(pdf: pd.DataFrame) -> Iterable[tuple[int, np.ndarray]]:
    if "n" in pdf:
        for g, n, x in zip(pdf["g"], pdf["n"], pdf["x"], strict=True):
            yield int(g), np.asarray(x).reshape(n, -1)
        return
    g = pdf["g"].to_numpy()
    x = np.stack(pdf["x"].to_numpy())
    for v in np.unique(g):
        yield int(v), x[g == v]


def seed_rows(df: DataFrame, sid: str, seed: int, per_group: int = SEED_ROWS) -> dict[int, np.ndarray]:
    """A hash-ordered sample per group; it depends on ids and seed, not on partitioning."""
    h = F.xxhash64(F.col(sid), F.lit(seed))
    # A hash cut first, so the ranking window sees a bounded expected number of rows per group.
    n = df.groupBy("g").count()
    cut = attach(df, n, ["g"]).withColumn("_h", h).where(
        F.pmod(F.col("_h"), F.lit(1 << 30)) < F.ceil(F.lit(4.0 * per_group * (1 << 30)) / F.col("count")))
    w = Window.partitionBy("g").orderBy("_h", sid)
    rows = cut.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_group).select("g", "_r", "x").collect()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["g"], r["_r"])):
        out.setdefault(r["g"], []).append(r["x"])
    return {g: np.asarray(v, dtype=float) for g, v in out.items()}


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centers = [x[rng.integers(len(x))]]
    d = ((x - centers[0]) ** 2).sum(1)
    for _ in range(1, k):
        p = d.sum()
        centers.append(x[rng.choice(len(x), p=d / p) if p > 0 else rng.integers(len(x))])
        d = np.minimum(d, ((x - centers[-1]) ** 2).sum(1))
    return np.asarray(centers)


def sq_dist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0.0)


@dataclass
class Fit:
    g: int
    k: int
    centers: np.ndarray
    score: float = np.inf            # inertia, or minus log-likelihood
    covs: np.ndarray | None = None
    weights: np.ndarray | None = None
    n: float = 0.0
    counts: np.ndarray | None = None
    extra: dict = field(default_factory=dict)


def lloyd(data: DataFrame | dict, fits: list[Fit], max_iter: int = 300, tol: float = 1e-4) -> list[Fit]:
    """Advance every k-means fit to convergence (relative center movement below ``tol``)."""
    open_ids = set(range(len(fits)))
    for it in range(max_iter + 1):
        table: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i in open_ids:
            table.setdefault(fits[i].g, []).append((i, fits[i].centers))

        def stats(groups, table=table):
            for g, x in groups:
                if g not in table:
                    continue
                columns, rows = np.ascontiguousarray(x.T), np.arange(len(x))
                size, shared = (x * x).sum(1), np.concatenate([(x * x).sum(0), x.sum(0)])
                for i, c in table[g]:
                    k = len(c)
                    d = x @ (-2 * c.T) + (c * c).sum(1)
                    near = d.argmin(1)
                    sums = np.stack([np.bincount(near, weights=v, minlength=k) for v in columns], 1)
                    yield i, np.concatenate([np.bincount(near, minlength=k), sums.ravel(), [np.maximum(d[rows, near] + size, 0.0).sum()], shared])

        for i, a in pass_sums(data, stats).items():
            f = fits[i]
            k, dim = f.centers.shape
            counts, sums = a[:k], a[k:k + k * dim].reshape(k, dim)
            f.score, f.counts, f.n = float(a[k + k * dim]), counts, counts.sum()
            sq, s = a[k + k * dim + 1:k + k * dim + 1 + dim], a[-dim:]
            spread = float((sq / f.n - (s / f.n) ** 2).mean())
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], f.centers)
            moved = float(((new - f.centers) ** 2).sum())
            if moved <= tol * max(spread, 1e-300) or it == max_iter:
                open_ids.discard(i)  # centers and score belong together
            else:
                f.centers = new
        if not open_ids:
            break
    return fits


def best_fits(fits: list[Fit]) -> dict[tuple[int, int], Fit]:
    best: dict[tuple[int, int], Fit] = {}
    for f in fits:
        if (f.g, f.k) not in best or f.score < best[f.g, f.k].score:
            best[f.g, f.k] = f
    return best


def kmeans(df: DataFrame, sid: str, ks: Iterable[int], seed: int, n_init: int = 10) -> dict[tuple[int, int], Fit]:
    """Best of ``n_init`` k-means fits per (group, k).

    Every start first converges on the seed sample; the passes over all rows begin there, so they
    are few.
    """
    starts = _starts(df, sid, ks, seed, n_init)
    return best_fits(dealt(df.sparkSession, held(packed(df, sid), len(starts)), starts, lloyd))


def _starts(df: DataFrame, sid: str, ks: Iterable[int], seed: int, n_init: int) -> list[Fit]:
    """Starts settled on the seed sample. A count above a group's size has none."""
    ks = list(ks)
    seeds = seed_rows(df, sid, seed, max(SEED_ROWS, SEED_ROWS_PER_CENTER * max(ks, default=1)))
    rng = np.random.default_rng(seed)
    fits = [Fit(g, k, plus_plus(x, k, rng)) for g, x in sorted(seeds.items()) for k in ks if k <= len(x) for _ in range(n_init)]
    return dealt(df.sparkSession, list(seeds.items()), fits, lloyd)


def log_joint(x: np.ndarray, f: Fit, dof: float | None) -> tuple[np.ndarray, np.ndarray | None]:
    """(component, row): log of weight times density, and the weights of a Student-t's moments; all components at once."""
    k, d = f.centers.shape
    chol = np.linalg.cholesky(f.covs)
    white = np.linalg.inv(chol)
    mid = f.centers.mean(0)
    z = white.reshape(k * d, d) @ np.ascontiguousarray((x - mid).T)
    z -= np.einsum("kij,kj->ki", white, f.centers - mid).reshape(-1, 1)
    z *= z
    maha = z.reshape(k, d, len(x)).sum(1)
    log_det = 2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(1)
    norm = np.log(f.weights) - 0.5 * log_det
    if dof is None:
        maha *= -0.5
        maha += (norm - 0.5 * d * np.log(2 * np.pi))[:, None]
        return maha, None
    norm += lgamma((dof + d) / 2) - lgamma(dof / 2) - 0.5 * d * np.log(dof * np.pi)
    return norm[:, None] - 0.5 * (dof + d) * np.log1p(maha / dof), (dof + d) / (dof + maha)


def _hard_moments(data, fits: list[Fit], eps: float) -> None:
    """Covariances and weights of the nearest-center partition."""
    table: dict[int, list[int]] = {}
    for i, f in enumerate(fits):
        table.setdefault(f.g, []).append(i)

    def hard(groups):
        for g, x in groups:
            for i in table.get(g, ()):
                near = sq_dist(x, fits[i].centers).argmin(1)
                yield i, np.concatenate([np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()])
                                         for m in (x[near == j] for j in range(fits[i].k))])

    for i, a in pass_sums(data, hard).items():
        f = fits[i]
        d = f.centers.shape[1]
        a = a.reshape(f.k, 1 + d + d * d)
        f.covs = np.empty((f.k, d, d))
        for j, row in enumerate(a):
            n, m, ss = row[0], row[1:1 + d], row[1 + d:].reshape(d, d)
            f.covs[j] = (ss - np.outer(m, m) / n) / (n - 1) + eps * np.eye(d) if n > d else np.eye(d)
        w = np.maximum(a[:, 0] / a[:, 0].sum(), 1e-3)
        f.weights = w / w.sum()


def _em(data, fits: list[Fit], dof: float | None, max_iter: int, tol: float, eps: float) -> None:
    """EM passes until every fit's log-likelihood settles; one pass gives all weighted moments."""
    open_ids = set(range(len(fits)))
    prev = dict.fromkeys(open_ids, -np.inf)
    for _ in range(max_iter):
        live: dict[int, list[int]] = {}
        for i in open_ids:
            live.setdefault(fits[i].g, []).append(i)

        def soft(groups, live=live):
            for g, x in groups:
                if g not in live:
                    continue
                d = x.shape[1]
                pairs = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1) if d <= PAIR_DIMS else None
                for i in live[g]:
                    f = fits[i]
                    r, u = log_joint(x, f, dof)
                    top = r.max(0)
                    r -= top
                    np.exp(r, out=r)
                    whole = r.sum(0)
                    r /= whole
                    ru = r if u is None else r * u
                    s2 = ru @ pairs if pairs is not None else np.stack([(x.T @ (ru[j][:, None] * x)).ravel() for j in range(f.k)])
                    yield i, np.concatenate([[(top + np.log(whole)).sum(), float(len(x))], r.sum(1), ru.sum(1), (ru @ x).ravel(), s2.ravel()])

        for i, a in pass_sums(data, soft).items():
            f = fits[i]
            k, d = f.centers.shape
            ll, n = a[0], a[1]
            nk, s0 = a[2:2 + k], a[2 + k:2 + 2 * k]
            s1 = a[2 + 2 * k:2 + 2 * k + k * d].reshape(k, d)
            s2 = a[2 + 2 * k + k * d:].reshape(k, d, d)
            f.score, f.n = -float(ll), n
            f.centers = s1 / np.maximum(s0, 1e-300)[:, None]
            for j, m in enumerate(f.centers):
                f.covs[j] = (s2[j] - s0[j] * np.outer(m, m)) / max(nk[j], 1e-300) + eps * np.eye(d)
            f.weights = np.maximum(nk / n, 1e-300)
            f.extra.setdefault("ll", []).append(float(ll))
            if abs(ll - prev[i]) < tol * (max(abs(prev[i]), 1.0) if dof is not None else n):
                open_ids.discard(i)
            prev[i] = ll
        if not open_ids:
            break


def mixture(df: DataFrame, sid: str, ks: Iterable[int], seed: int, dof: float | None = None, n_init: int = 1,
            max_iter: int = 100, tol: float | None = None, eps: float = 1e-6) -> dict[tuple[int, int], Fit]:
    """Gaussian (``dof`` None) or fixed-dof Student-t mixtures by EM from k-means starts.

    The log-likelihood change ends the loop: relative to its size for Student-t, per row for
    Gaussian. The k-means starts, their covariances and weights, and EM itself see all rows.
    """
    tol = tol if tol is not None else (1e-4 if dof is not None else 1e-3)
    spark, rows = df.sparkSession, packed(df, sid)
    starts = _starts(df, sid, ks, seed, 10 if n_init == 1 else n_init)
    starts = dealt(spark, held(rows, len(starts)), starts, lloyd)
    if n_init == 1:
        starts = list(best_fits(starts).values())
    fits = [Fit(f.g, f.k, f.centers.copy()) for f in starts]
    return best_fits(dealt(spark, held(rows, len(fits)), fits, partial(_mixed, dof=dof, max_iter=max_iter, tol=tol, eps=eps)))


def _mixed(data, fits: list[Fit], dof: float | None, max_iter: int, tol: float, eps: float) -> list[Fit]:
    _hard_moments(data, fits, eps)
    _em(data, fits, dof, max_iter, tol, eps)
    return fits


def label_column(fits: dict[int, Fit], dof: float | None = None) -> Column:
    """Nearest center, or most likely component for a mixture; -1 in pools without a fit."""
    @F.pandas_udf("int")
    def label(g: pd.Series, x: pd.Series) -> pd.Series:
        res = np.full(len(g), -1, dtype=np.int32)
        if len(g):
            gv, xv = g.to_numpy(), np.stack(x.to_numpy())
            for v in np.unique(gv):
                f, m = fits.get(int(v)), gv == v
                if f is not None:
                    res[m] = (sq_dist(xv[m], f.centers).argmin(1) if f.covs is None
                              else log_joint(xv[m], f, dof)[0].argmax(0))
        return pd.Series(res)

    return label("g", "x")


def assign(df: DataFrame, fits: dict[int, Fit], out: str = "label", dof: float | None = None) -> DataFrame:
    return df.withColumn(out, label_column(fits, dof))
