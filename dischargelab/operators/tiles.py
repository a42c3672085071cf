"""All-to-all distance work cut into tiles of bounded size.

Pairs are never rows. Rows of equal values are one row with a count first. Each group is hashed into blocks. A task of the
neighbour search or of silhouettes owns one block and all rows of the group stream past it; only the k best neighbours of its rows,
or sums of scores, leave it. Other work joins two blocks in a tile. The number of
distances is quadratic in the distinct rows by definition; memory per task is not, and a row is sent to as many tasks as its
group has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.session import attach, materialize, shuffle_width

BLOCK = 2048  # blocks of small groups have about so many rows,
BLOCK_ROWS = 1 << 15  # those of large groups at most about so many
CHUNK = 1 << 22  # distances that are held at once
CACHED = 1 << 17  # or so many, where they stay in a core's cache
STRIP = 32  # rows that go past the others together
FEW_DIMS = 8
SALTS = 64
NEAR = 1e-6  # squared distances below this share of the squared norms are taken by differences


def tiles(df: DataFrame, sid: str, block: int, owned: bool = False):
    """Rows grouped by tile (g, row block, column block), row block <= column block; ``_b`` is a row's own block.

    With ``owned`` rows instead of groups: a block ``_r`` and, behind its own rows (``_own``), all rows of its group.
    """
    spark = df.sparkSession
    spread = math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))
    n = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(n / BLOCK_ROWS), F.least(F.ceil(n / block), F.lit(spread).cast("long")))
    rows = attach(df, df.groupBy("g").agg(blocks.alias("_nb")), ["g"]).withColumn("_b", F.pmod(F.xxhash64(sid), F.col("_nb")))
    if owned:
        past = rows.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1))).withColumn("_own", F.lit(False))
        cols = [*df.columns, "_r", "_own"]
        met = rows.withColumn("_r", F.col("_b")).withColumn("_own", F.lit(True)).select(*cols).unionByName(past.select(*cols))
        return met.repartition(4 * shuffle_width(spark), "g", "_r").sortWithinPartitions("g", "_r", F.col("_own").desc())
    out = rows.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    out = out.select(*df.columns, "_b", F.least("_b", "_o").alias("_r"), F.greatest("_b", "_o").alias("_c"))
    return out.repartition(4 * shuffle_width(spark), "g", "_r", "_c").groupBy("g", "_r", "_c")  # long work: not to be coalesced


def _by_difference(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of given pairs, which lose no digits."""
    out = np.zeros(len(i))
    for d in range(a.shape[1]):
        out += (a[i, d] - b[j, d]) ** 2
    return out


def sq_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the expanded square. That loses digits where rows are near, so those are taken by differences."""
    mid = a.mean(0)
    a0, b0 = a - mid, b - mid
    size = (a0 * a0).sum(1)[:, None] + (b0 * b0).sum(1)[None, :]
    out = size - 2.0 * (a0 @ b0.T)
    i, j = np.nonzero(~(out > NEAR * size))
    out[i, j] = _by_difference(a, b, i, j)
    return out


def _few_dims(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Distances of rows of few dimensions by differences, in pieces that stay in a core's cache."""
    out = np.empty((len(x), columns.shape[1]))
    part = np.empty((len(x), CACHED // STRIP))
    for at in range(0, out.shape[1], part.shape[1]):
        here = out[:, at:at + part.shape[1]]
        gap = part[:, : here.shape[1]]
        here[:] = 0.0
        for j, column in enumerate(columns):
            np.subtract(x[:, j, None], column[at:at + part.shape[1]], out=gap)
            here += np.multiply(gap, gap, out=gap)
        np.sqrt(here, out=here)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(sq_distances(a, b))


def _chunks(n: int, other: int) -> Iterator[slice]:
    step = max(1, CHUNK // max(other, 1))
    return (slice(at, at + step) for at in range(0, n, step))


def _cluster_sums(xa: np.ndarray, xb: np.ndarray, lab: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
    """Add to ``sums`` (rows of xa, labeling, label) the distances of every row of xa to the rows of xb, of which ``n`` are equal each.

    Rows of xb with the same labels in all labelings are one cell: distances are added per cell first, then cells per label.
    """
    order = np.lexsort(lab.T[::-1])
    xb, lab, n = xb[order], lab[order], n[order]
    first = np.flatnonzero(np.r_[True, (lab[1:] != lab[:-1]).any(1)])
    of = np.zeros((len(first), *sums.shape[1:]))
    for s in range(lab.shape[1]):
        ok = np.flatnonzero(lab[first, s] >= 0)
        of[ok, s, lab[first[ok], s]] = 1.0
    of, flat, many = of.reshape(len(first), -1), sums.reshape(len(sums), -1), (n != 1).any()
    used = np.flatnonzero(of.any(0))
    of, columns = of[:, used], np.ascontiguousarray(xb.T)
    for at in range(0, len(xa), STRIP):
        x = xa[at:at + STRIP]
        d = distances(x, xb) if x.shape[1] > FEW_DIMS else _few_dims(x, columns)
        if many:
            d *= n
        flat[at:at + STRIP, used] += np.add.reduceat(d, first, axis=1) @ of


def _scores(sums: np.ndarray, lab: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Silhouette of every row and labeling; nan where it has none. Identical points score 0, as a singleton does."""
    out = np.full(lab.shape, np.nan)
    for s in range(lab.shape[1]):
        rows = np.flatnonzero(lab[:, s] >= 0)
        own, size = lab[rows, s], counts[s]
        with np.errstate(invalid="ignore", divide="ignore"):
            means = np.where(size > 0, sums[rows, s] / size, np.inf)
            means[np.arange(len(rows)), own] = np.inf
            b = means.min(1, initial=np.inf)
            a = sums[rows, s, own] / (size[own] - 1)
            top = np.maximum(a, b)
            score = np.where((size[own] > 1) & (top > 0), (b - a) / top, 0.0)
        out[rows, s] = np.where(np.isfinite(b), score, np.nan)
    return out


def silhouette(df: DataFrame, sid: str, n_labelings: int = 1, block: int = BLOCK) -> DataFrame:
    """(g, labeling, silhouette, n) for rows (g, sid, x, labels array<int>); label -1 is left out.

    Plain Euclidean silhouette of every labeling at once. A task owns a block of a group's rows; all rows of the group stream past
    it, so the distance sums of a row are complete in its task and only two numbers per labeling leave it.
    A singleton scores 0; fewer than two populated clusters give no row.
    """
    rows = df.select("g", F.col(sid).cast("long").alias("sid"), "x", F.col("labels").cast("array<int>").alias("labels"))
    rows = materialize(rows.groupBy("g", "x", "labels").agg(F.min("sid").alias("sid"), F.count(F.lit(1)).alias("n")))
    wide = int(rows.select(F.max(F.array_max("labels"))).first()[0] or 0) + 1
    counts: dict[int, np.ndarray] = {}
    cells = rows.select("g", "n", F.posexplode("labels").alias("s", "m")).where("m >= 0").groupBy("g", "s", "m").agg(F.sum("n").alias("n"))
    for r in cells.collect():  # one number per group, labeling and label
        counts.setdefault(r["g"], np.zeros((n_labelings, wide)))[r["s"], r["m"]] = r["n"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own = sums = None
        held: list = []

        def absorb(part=None):
            nonlocal held
            held += [] if part is None else [part]
            if held and (part is None or sum(len(h[2]) for h in held) >= BLOCK_ROWS):
                x, lab, n = (np.concatenate(c) for c in zip(*held))
                held = []
                _cluster_sums(own[0], x, lab, n, sums)

        def finish():
            absorb()
            x, lab, n = own
            score, weight = _scores(sums, lab, counts[at[0]] if at[0] in counts else np.zeros((n_labelings, wide))), n[:, None]
            some = ~np.isnan(score)
            total, size = np.where(some, score * weight, 0.0).sum(0), (some * weight).sum(0)
            ok = np.flatnonzero(size)
            return pa.record_batch({"g": pa.array(np.full(len(ok), at[0], np.int32)), "labeling": pa.array(ok.astype(np.int32)),
                                    "total": pa.array(total[ok]), "n": pa.array(size[ok].astype(np.int64))})

        for batch in batches:
            if not batch.num_rows:
                continue
            g, r, mine, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "_r", "_own", "n"))
            x, lab = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1) for c in ("x", "labels"))
            edge = np.r_[0, np.flatnonzero((g[1:] != g[:-1]) | (r[1:] != r[:-1]) | (mine[1:] != mine[:-1])) + 1, len(g)]
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                key, part = (int(g[lo]), int(r[lo])), (x[lo:hi], lab[lo:hi], n[lo:hi])
                if key != at:
                    if own is not None:
                        yield finish()
                    at, own, sums = key, None, None
                if mine[lo]:  # a block's own rows come first
                    own = part if own is None else tuple(np.concatenate(c) for c in zip(own, part))
                elif own is not None:
                    if sums is None:
                        sums = np.zeros((len(own[0]), n_labelings, wide))
                    absorb(part)
        if own is not None:
            yield finish()

    met = tiles(rows, "sid", block, True).select("g", "_r", "_own", "x", "labels", "n")
    parts = met.mapInArrow(stream, "g int, labeling int, total double, n long")
    return parts.groupBy("g", "labeling").agg((F.sum("total") / F.sum("n")).alias("silhouette"), F.sum("n").alias("n"))


def _nearer(best: tuple, x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row number, id, distance) of the k nearest rows to every row of x, of ``best`` so far and the rows y; ties to the smaller id,
    and a row is not its own."""
    kth, (row, _, dist) = np.full(len(x), np.inf), best
    last = np.flatnonzero(np.r_[row[1:] != row[:-1], True][: len(row)])
    full = np.diff(np.r_[-1, last]) >= k
    kth[row[last[full]]] = dist[last[full]] ** 2
    found = [best]
    for at in _chunks(len(x), len(y)):
        d = sq_distances(x[at], y)
        d[ids[at][:, None] == others[None, :]] = np.inf
        top = kth[at]
        some = d[:, : max(BLOCK, k + 1)]
        if some.shape[1] > k and not np.isfinite(top).all():  # the k-th best of some columns bounds the k-th best of all
            top = np.fmin(top, np.partition(some, k - 1, axis=1)[:, k - 1])
        top = np.where(np.isfinite(top), top * (1 + NEAR), np.finfo(float).max)
        i, j = np.nonzero(d <= top[:, None])  # few others stay below it
        found.append((i + at.start, others[j], np.sqrt(_by_difference(x[at], y, i, j))))
    row, other, dist = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((other, dist, row))
    row, other, dist = row[order], other[order], dist[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], other[keep], dist[keep]


def _class_lists(classes: DataFrame, k: int, block: int) -> DataFrame:
    """(g, sid, best): the k nearest other rows, of no equal values, as (dist, other). A task owns a block of rows and all rows of
    the group stream past it, so a row's list leaves its task once and complete."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own = best = None
        held: list = []

        def absorb(part=None):
            nonlocal held, best
            held += [] if part is None else [part]
            if held and (part is None or sum(len(h[1]) for h in held) >= BLOCK_ROWS):
                x, ids = (np.concatenate(c) for c in zip(*held))
                held = []
                best = _nearer(best, *own, x, ids, k)

        def finish():
            absorb()
            row, other, dist = best
            first = np.searchsorted(row, np.arange(len(own[1]) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(dist), pa.array(other)], names=["dist", "other"])
            return pa.record_batch({"g": pa.array(np.full(len(own[1]), at[0], np.int32)), "sid": pa.array(own[1]),
                                    "best": pa.ListArray.from_arrays(pa.array(first), pairs)})

        for batch in batches:
            if not batch.num_rows:
                continue
            g, r, mine, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "_r", "_own", "sid"))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1)
            edge = np.r_[0, np.flatnonzero((g[1:] != g[:-1]) | (r[1:] != r[:-1]) | (mine[1:] != mine[:-1])) + 1, len(g)]
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                key, part = (int(g[lo]), int(r[lo])), (x[lo:hi], ids[lo:hi])
                if key != at:
                    if own is not None:
                        yield finish()
                    at, own, best = key, None, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                if mine[lo]:  # a block's own rows come first
                    own = part if own is None else tuple(np.concatenate(c) for c in zip(own, part))
                elif own is not None:
                    absorb(part)
        if own is not None:
            yield finish()

    met = tiles(classes, "sid", block, True).select("g", "_r", "_own", "sid", "x")
    return met.mapInArrow(stream, "g int, sid long, best array<struct<dist:double,other:long>>")


def near_lists(df: DataFrame, sid: str, k: int, block: int = BLOCK) -> DataFrame:
    """(g, sid, best): the k nearest other rows of the same group as (dist, other), in order.

    Rows of equal values form a class, named by its smallest id; classes look for their k nearest other classes. A class
    stands for its k + 1 smallest ids, as no neighbour list can reach beyond them.
    """
    rows = df.select("g", F.col(sid).cast("long").alias("sid"), "x")
    low = lambda ids: F.slice(F.array_sort(ids), 1, k + 1)
    some = rows.groupBy("g", "x", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).alias("_p")).agg(
        low(F.collect_list("sid")).alias("ids"), F.count(F.lit(1)).alias("n"))
    classes = some.groupBy("g", "x").agg(low(F.flatten(F.collect_list("ids"))).alias("ids"), F.sum("n").alias("n"))
    classes = materialize(classes.withColumn("sid", F.col("ids")[0]))
    best = _class_lists(classes.select("g", "sid", "x"), k, block)
    if classes.where("n > 1").isEmpty():  # a row is its class
        return best
    w = Window.partitionBy("g", "sid").orderBy("dist", "other")
    ids = classes.select("g", F.col("sid").alias("other"), "ids")
    met = best.select("g", "sid", F.explode("best").alias("_s")).select("g", "sid", "_s.other", "_s.dist")
    met = met.join(ids, ["g", "other"]).select("g", "sid", F.explode("ids").alias("other"), "dist")
    own = classes.select("g", "sid", F.explode("ids").alias("other"), F.lit(0.0).alias("dist"))
    best = met.unionByName(own).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    lists = best.groupBy("g", "sid").agg(F.collect_list(F.struct("dist", "other")).alias("best"))
    named = rows.join(classes.select("g", "x", F.col("sid").alias("class")), ["g", "x"]).select("g", "sid", "class")
    each = named.join(lists.withColumnRenamed("sid", "class"), ["g", "class"])
    others = F.slice(F.array_sort(F.filter("best", lambda s: s["other"] != F.col("sid"))), 1, k)
    return each.select("g", "sid", others.alias("best"))


def nearest(df: DataFrame, sid: str, k: int, block: int = BLOCK) -> DataFrame:
    """(g, sid, rank, other, dist): the k nearest other rows of the same group, ranks from 1."""
    flat = near_lists(df, sid, k, block).select("g", "sid", F.posexplode("best").alias("_p", "_s"))
    return flat.select("g", "sid", F.col("_s.other").alias("other"), F.col("_s.dist").alias("dist"), (F.col("_p") + 1).alias("rank"))
