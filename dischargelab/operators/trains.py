"""Discharge trains: refractory clean-up, intervals, regularity and rates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dischargelab.functions.kernels import greedy_spacing
from dischargelab.operators.ordered import islands, neighbours, quantiles
from dischargelab.session import attach, group_bound, groups_bounded, largest_group, materialize


ISLAND_ROWS = 200_000  # longest run of close spikes that is one array


# --- refractory clean-up ------------------------------------------------------------------------

def _greedy_udf(radius: float):
    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def keep(t: pd.Series, size: pd.Series, tie: pd.Series) -> pd.Series:
        lengths = np.array([len(a) for a in t], dtype=np.int64)
        if lengths.sum() == 0:
            return pd.Series([np.array([], dtype=bool)] * len(t))
        times, sizes, ties = (np.concatenate(list(c)) for c in (t, size, tie))
        group = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.empty(len(times), dtype=np.int64)
        rank[np.lexsort((ties, times, -sizes))] = np.arange(len(times))
        kept = greedy_spacing(times, rank, radius, group) == 1
        return pd.Series(np.split(kept, np.cumsum(lengths)[:-1]))

    return keep


def min_isi(spikes: DataFrame, keys: list[str], t_min: float, t: str = "t", amp: str = "amp",
            sid: str = "spike_id") -> DataFrame:
    """Add ``keep``: greedy largest-first removal of spikes closer than ``t_min`` within ``keys``.

    Runs of spikes whose consecutive gaps stay below ``t_min`` are independent of each other, so
    each is one small array handled by a vectorized function, on top of the hash partitioning the
    gap window already made. A run too long for one task is solved in time chunks instead. Only
    time, amplitude and id take part; wider rows get the verdict by id.
    """
    core = spikes.select(*keys, t, amp, sid)
    top = largest_group(core, keys)
    bounded = top <= group_bound(spikes.sparkSession)
    rows = neighbours(core, keys, [t, sid], prev={"_pt": F.col(t)}, bounded=bounded)
    starts = F.col("_pt").isNull() | (F.col(t) - F.col("_pt") >= F.lit(t_min))
    rows = islands(rows, keys, [t, sid], starts, "_isl", bounded=bounded).drop("_pt")
    limit = min(ISLAND_ROWS, group_bound(spikes.sparkSession))
    if not bounded:
        rows = materialize(rows)
    if top > limit and not groups_bounded(rows, keys + ["_isl"], limit):
        flags = _min_isi_chunked(core, keys, t_min, t, amp, sid)
    else:
        packed = rows.groupBy(*keys, "_isl").agg(
            F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(sid).alias("id"), F.col(amp).alias("a")))).alias("_s"))
        verdict = _greedy_udf(t_min)(F.transform("_s", lambda s: s["t"].cast("double")),
                                     F.transform("_s", lambda s: F.abs(s["a"]).cast("double")),
                                     F.transform("_s", lambda s: s["id"].cast("long")))
        pairs = F.zip_with("_s", "_k", lambda s, k: F.struct(s.alias("s"), k.alias("k")))
        flags = packed.withColumn("_k", verdict).select(*keys, F.explode(pairs).alias("_z")).select(
            *keys, F.col("_z.s.t").alias(t), F.col("_z.s.a").alias(amp), F.col("_z.s.id").alias(sid), F.col("_z.k").alias("keep"))
    if set(spikes.columns) == set(core.columns):
        return flags.select(*spikes.columns, "keep")
    return spikes.join(flags.select(*keys, sid, "keep"), keys + [sid]).select(*spikes.columns, "keep")


def _min_isi_chunked(spikes: DataFrame, keys: list[str], t_min: float, t: str, amp: str,
                     sid: str) -> DataFrame:
    """Exact greedy removal for trains of any length.

    Each round solves every time chunk with the spikes of its neighbours within ``t_min`` as
    read-only halo. A spike whose verdict hangs on an open halo spike stays open for the next
    round; the best open spike of any neighbourhood is always decided, so rounds end.
    """
    bound = min(ISLAND_ROWS, group_bound(spikes.sparkSession))
    state = materialize(spikes.withColumn("_st", F.lit(0).cast("byte")))
    dense = largest_group(state.withColumn("_c", F.floor(F.col(t) / t_min)), keys + ["_c"])
    width = t_min * max(1, min(256, bound // max(dense, 1)))
    if dense > bound:
        state = _thin(state, keys, t_min, t, amp, sid, bound)
    schema = T.StructType(state.schema.fields)
    order = state.columns

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([t, sid], kind="stable").reset_index(drop=True)
        rank = np.empty(len(pdf), dtype=np.int64)
        rank[np.lexsort((pdf[sid], pdf[t], -pdf[amp].abs()))] = np.arange(len(pdf))
        own = pdf["_own"].to_numpy()
        pdf["_st"] = greedy_spacing(pdf[t].to_numpy(), rank, t_min, None,
                                    pdf["_st"].to_numpy(), ~own).astype(np.int8)
        return pdf.loc[own, order]

    reach = t_min * (1 + 1e-9)
    while True:
        spread = state.withColumn("_c", F.explode(F.array_distinct(F.array(
            F.floor((F.col(t) - reach) / width), F.floor(F.col(t) / width),
            F.floor((F.col(t) + reach) / width)))))
        spread = spread.withColumn("_own", F.col("_c") == F.floor(F.col(t) / width))
        state = materialize(spread.groupBy(*keys, "_c").applyInPandas(solve, schema))
        if state.where("_st = 0").isEmpty():
            break
    return state.withColumn("keep", F.col("_st") == 1).drop("_st")


def _thin(state: DataFrame, keys, t_min, t, amp, sid, bound) -> DataFrame:
    """Settle overfull cells of width ``t_min`` with map-side-combined maxima.

    The best open spike of a cell is kept when it also beats the best of both adjacent cells, and
    every open spike within ``t_min`` of it, which includes its whole cell, is dropped.
    """
    cell = F.floor(F.col(t) / t_min)
    best = F.struct(F.abs(F.col(amp)).alias("a"), (-F.col(t)).alias("nt"), (-F.col(sid)).alias("nid"))
    while not groups_bounded(state.where("_st = 0").withColumn("_c", cell), keys + ["_c"], bound):
        tops = (state.where("_st = 0").withColumn("_cell", cell)
                .groupBy(*keys, "_cell").agg(F.max(best).alias("_b")))
        near = tops.select(*keys, F.explode(F.sequence(F.col("_cell") - 1, F.col("_cell") + 1)).alias("_cell"),
                           F.col("_b").alias("_n"))
        wins = (tops.join(near.groupBy(*keys, "_cell").agg(F.max("_n").alias("_n")), keys + ["_cell"])
                .where(F.col("_b") == F.col("_n")))
        zones = wins.select(*keys, F.explode(F.sequence(F.col("_cell") - 1, F.col("_cell") + 1)).alias("_cell"),
                            (-F.col("_b.nt")).alias("_wt"), (-F.col("_b.nid")).alias("_wid"))
        zones = zones.groupBy(*keys, "_cell").agg(F.collect_list(F.struct("_wt", "_wid")).alias("_z"))
        joined = state.withColumn("_cell", cell).join(zones, keys + ["_cell"], "left")
        is_win = F.exists("_z", lambda z: z["_wid"] == F.col(sid))
        is_near = F.exists("_z", lambda z: F.abs(z["_wt"] - F.col(t)) < t_min)
        state = materialize(joined.withColumn("_st", F.when(
            (F.col("_st") == 0) & F.col("_z").isNotNull(),
            F.when(is_win, 1).when(is_near, 2).otherwise(0)).otherwise(F.col("_st")).cast("byte"))
            .drop("_cell", "_z"))
    return state


# --- intervals ----------------------------------------------------------------------------------

def intervals(spikes: DataFrame, keys: list[str], t: str = "t", sid: str = "spike_id") -> DataFrame:
    """Inter-spike intervals in ms; the first spike of a train has none."""
    rows = neighbours(spikes.select(*keys, sid, t), keys, [t, sid], prev={"_pt": F.col(t)})
    return (rows.where(F.col("_pt").isNotNull())
            .withColumn("isi_ms", (F.col(t) - F.col("_pt")) * 1000.0).drop("_pt"))


def isi_cv(spikes: DataFrame, keys: list[str], t: str = "t", sid: str = "spike_id") -> DataFrame:
    """Spike count and population CV of the intervals; NULL below 3 spikes or for a zero mean."""
    rows = neighbours(spikes.select(*keys, sid, t), keys, [t, sid], prev={"_pt": F.col(t)})
    isi = F.col(t) - F.col("_pt")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spikes"), F.avg(isi).alias("_m"),
                                  F.stddev_pop(isi).alias("_s"))
    return out.select(*keys, "n_spikes", F.when(
        (F.col("n_spikes") >= 3) & (F.col("_m") > 0), F.col("_s") / F.col("_m")).alias("isi_cv"))


def isi_axis(isis: DataFrame, bin_ms: float, cap_ms: float, share: float = 0.9) -> DataFrame:
    """Shared histogram axis: 99th percentile, capped above, at least three bins, over ``share``."""
    top = quantiles(isis, [], "isi_ms", {"_p": 0.99})
    limit = F.greatest(F.least(F.coalesce("_p", F.lit(0.0)), F.lit(cap_ms)), F.lit(bin_ms * 3))
    return top.select((limit / share).alias("xlim_max"))


def isi_histogram(isis: DataFrame, keys: list[str], bin_ms: float, cap_ms: float) -> DataFrame:
    """Counts per ``bin_ms`` bin on the shared axis; edges run to the first one at or past its end.

    Values beyond the last edge are left out and the last bin is closed, as NumPy does. Empty bins count zero.
    """
    axis = isi_axis(isis, bin_ms, cap_ms)
    n_bins = F.ceil((F.col("xlim_max") + bin_ms) / bin_ms) - 1
    rows = isis.crossJoin(F.broadcast(axis.withColumn("_n", n_bins)))  # one row on the right
    edge = F.col("_n") * bin_ms
    b = F.least(F.floor(F.col("isi_ms") / bin_ms), F.col("_n") - 1)
    counts = rows.where(F.col("isi_ms") <= edge).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = rows.select(*keys, "_n").distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("bin"))
    return bins.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])


def firing_rate(spikes: DataFrame, keys: list[str], duration: Column | float) -> DataFrame:
    d = duration if isinstance(duration, Column) else F.lit(float(duration))
    return spikes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spikes")).withColumn(
        "rate_hz", F.col("n_spikes") / d)


def cluster_floor(spikes: DataFrame, keys: list[str], max_rate: float, duration: float) -> DataFrame:
    """Fewest types that keep every type at or below ``max_rate``."""
    n = spikes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spikes"))
    return n.withColumn("n0", F.greatest(F.ceil(F.col("n_spikes") / (max_rate * duration)), F.lit(1)))


# --- labels -------------------------------------------------------------------------------------

def relabel_dense(spikes: DataFrame, keys: list[str], label: str = "label", out: str = "label") -> DataFrame:
    """Renumber labels 0..k-1 in label order. Only the distinct labels are ranked."""
    w = Window.partitionBy(*keys).orderBy("_old")
    names = (spikes.select(*keys, F.col(label).alias("_old")).distinct()
             .withColumn("_new", (F.row_number().over(w) - 1).cast("int")))
    joined = attach(spikes.withColumn("_old", F.col(label)), names, keys + ["_old"])
    return joined.select(*[c for c in spikes.columns if c != out], F.col("_new").alias(out))


def keep_big_types(spikes: DataFrame, keys: list[str], min_spikes: int, label: str = "label",
                   out: str = "label") -> DataFrame:
    """Set types below ``min_spikes`` to -1 and renumber the others."""
    w = Window.partitionBy(*keys).orderBy(label)
    big = (spikes.groupBy(*keys, label).count().where(F.col("count") >= min_spikes)
           .withColumn("_new", F.row_number().over(w) - 1).drop("count"))
    rows = attach(spikes, big, keys + [label], "left")
    return rows.withColumn(out, F.coalesce("_new", F.lit(-1)).cast("int")).drop("_new").select(
        *[c for c in spikes.columns if c != out], out)


# --- smoothed rates -----------------------------------------------------------------------------

LOSSLESS = 39.0  # sigmas beyond which a kernel underflows to zero
GRID_BLOCK = 512


def _parts(near: DataFrame, points: list[str]) -> tuple[DataFrame, bool]:
    """Times ``_x`` with weights ``_w`` and a part ``_s`` of their block; whether any block has several parts."""
    bound = group_bound(near.sparkSession)
    if groups_bounded(near, points, bound):
        return near.select(*points, "_x", F.lit(1.0).alias("_w"), F.lit(0).cast("long").alias("_s")), False
    near = near.groupBy(*points, "_x").agg(F.count(F.lit(1)).cast("double").alias("_w"))
    full = near.groupBy(*points).agg(F.ceil(F.count(F.lit(1)) / bound).alias("_k")).where("_k > 1")
    part = F.expr("pmod(xxhash64(_x), coalesce(_k, 1))").alias("_s")
    return attach(near, full, points, "left").select(*points, "_x", "_w", part), True


def gaussian_rate(spikes: DataFrame, epochs: DataFrame, keys: list[str], unit: str, dt: float,
                  sigma: float, t: str = "t", block: int = GRID_BLOCK) -> DataFrame:
    """Sum of unit-area Gaussian kernels at every grid point of each epoch, per unit.

    ``epochs`` has ``keys`` plus ``a``, ``b``; its grid is ``a + g*dt`` below ``b``. Spikes meet blocks of
    grid points, a spike in every block within ``LOSSLESS`` sigmas, so sums are those over all spikes; units
    yield all grid points of their epochs, also those of rate zero. Spikes of an overfull block are counted by
    time and dealt by its hash to parts within the group bound, whose rates are added.
    """
    ep = epochs.where(F.col("b") - F.col("a") >= dt).withColumn("_n", F.ceil((F.col("b") - F.col("a")) / dt))
    last = F.floor((F.col("_n") - 1) / block)
    rows = attach(spikes.select(*keys, unit, t), ep, keys)
    own = [*keys, unit, "_n"]
    grid = rows.select(*own).distinct().select(*own, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_b"), F.lit(None).cast("double").alias("_x"))
    x, width = F.col(t) - F.col("a"), dt * block
    lo = F.greatest(F.floor((x - LOSSLESS * sigma) / width), F.lit(0).cast("long"))
    hi = F.least(F.floor((x + LOSSLESS * sigma) / width), last)
    near = rows.where((F.col(t) >= F.col("a")) & (F.col(t) < F.col("b"))).select(*own, F.explode(F.sequence(lo, hi)).alias("_b"), x.alias("_x"))

    points = [*own, "_b"]
    near, split = _parts(near, points)
    grid = grid.select(*points, "_x", F.lit(None).cast("double").alias("_w"), F.lit(0).cast("long").alias("_s"))

    @F.pandas_udf("array<double>")
    def rate(times: pd.Series, weights: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for xs, ws, b, m in zip(times, weights, at, n):
            g, acc = np.arange(b * block, min(m, (b + 1) * block)) * dt, 0.0
            for i in range(0, len(xs), 1024):  # bounds the table of points and spikes
                bell = np.exp(-0.5 * ((g - np.asarray(xs[i:i + 1024])[:, None]) / sigma) ** 2)
                acc = acc + (bell * np.asarray(ws[i:i + 1024])[:, None]).sum(axis=0)
            out.append(acc / (sigma * math.sqrt(2 * math.pi)) if len(xs) else np.zeros(len(g)))
        return pd.Series(out)

    blocks = grid.unionByName(near).groupBy(*points, "_s").agg(F.collect_list("_x").alias("_xs"), F.collect_list("_w").alias("_ws"))
    flat = blocks.select(*keys, unit, "_b", F.posexplode(rate("_xs", "_ws", "_b", "_n")).alias("_p", "rate"))
    rates = flat.select(*keys, unit, (F.col("_b") * block + F.col("_p")).alias("g"), "rate")
    return rates.groupBy(*keys, unit, "g").agg(F.sum("rate").alias("rate")) if split else rates


def power_vs_rate(rates: DataFrame, amplitudes: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Total rate F and amplitude-weighted power P per grid point.

    ``amplitudes`` has ``keys``, ``unit``, ``amp`` and the template fallback ``ptp``.
    """
    a = amplitudes.select(*keys, unit, F.coalesce("amp", "ptp").alias("_a"))
    return attach(rates, a, keys + [unit]).groupBy(*keys, "g").agg(
        F.sum("rate").alias("f"), F.sum(F.col("_a") * F.col("rate")).alias("p"))


def power_of_spikes(spikes: DataFrame, epochs: DataFrame, amplitudes: DataFrame, keys: list[str], unit: str, dt: float,
                    sigma: float, t: str = "t", block: int = GRID_BLOCK) -> DataFrame:
    """``power_vs_rate`` of ``gaussian_rate`` without a row per unit and grid point.

    A block of a run's grid adds the kernels of the spikes of all units, plain for F and times the unit's amplitude
    for P. Units without an amplitude add nothing to P, which is NULL where no unit has one.
    """
    amp = amplitudes.select(*keys, unit, F.coalesce("amp", "ptp").alias("_a"))
    ep = epochs.where(F.col("b") - F.col("a") >= dt).withColumn("_n", F.ceil((F.col("b") - F.col("a")) / dt))
    rows = attach(attach(spikes.select(*keys, unit, t), amp, keys + [unit]), ep, keys)
    last, own = F.floor((F.col("_n") - 1) / block), [*keys, "_n"]
    points = [*own, "_b"]
    grid = rows.groupBy(*own).agg(F.max(F.col("_a").isNotNull()).alias("_has")).select(
        *own, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_b"), "_has")
    x, width = F.col(t) - F.col("a"), dt * block
    lo = F.greatest(F.floor((x - LOSSLESS * sigma) / width), F.lit(0).cast("long"))
    hi = F.least(F.floor((x + LOSSLESS * sigma) / width), last)
    near = rows.where((F.col(t) >= F.col("a")) & (F.col(t) < F.col("b"))).select(
        *own, F.explode(F.sequence(lo, hi)).alias("_b"), x.alias("_x"), F.coalesce("_a", F.lit(0.0)).alias("_a"))
    bound, one = group_bound(spikes.sparkSession), F.lit(0).cast("long")
    top = largest_group(near, points)
    if top <= bound:
        near = near.select(*points, "_x", F.lit(1.0).alias("_w"), "_a", one.alias("_s"))
    else:  # an overfull block counts equal spikes and deals them to parts
        near = near.groupBy(*points, "_x", "_a").agg(F.count(F.lit(1)).cast("double").alias("_w"))
        near = near.select(*points, "_x", "_w", "_a", F.pmod(F.xxhash64("_x", "_a"), F.lit(-(-top // bound))).alias("_s"))
    void = F.lit(None).cast("double")
    grid = grid.select(*points, void.alias("_x"), void.alias("_w"), void.alias("_a"), one.alias("_s"), "_has")

    @F.pandas_udf("array<double>")
    def sums(times: pd.Series, weights: pd.Series, heights: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
        """F, then P, at the points of a block."""
        out = []
        for xs, ws, hs, b, m in zip(times, weights, heights, at, n):
            g = np.arange(b * block, min(m, (b + 1) * block)) * dt
            acc = np.zeros((2, len(g)))
            for i in range(0, len(xs), 1024):  # bounds the table of points and spikes
                bell = np.exp(-0.5 * ((g - np.asarray(xs[i:i + 1024])[:, None]) / sigma) ** 2)
                w = np.asarray(ws[i:i + 1024])
                acc += np.stack([w, w * np.asarray(hs[i:i + 1024])]) @ bell
            out.append((acc / (sigma * math.sqrt(2 * math.pi))).ravel())
        return pd.Series(out)

    cells = grid.unionByName(near, allowMissingColumns=True).groupBy(*points, "_s").agg(
        *[F.collect_list(c).alias(c) for c in ("_x", "_w", "_a")], F.max("_has").alias("_has"))
    cells = cells.withColumn("_r", sums("_x", "_w", "_a", "_b", "_n")).withColumn("_m", F.expr("size(_r) div 2").cast("int"))
    flat = cells.select(*keys, "_b", "_has", F.posexplode(F.arrays_zip(
        F.slice("_r", F.lit(1), F.col("_m")).alias("f"), F.slice("_r", F.col("_m") + 1, F.col("_m")).alias("p"))).alias("_p", "_z"))
    flat = flat.select(*keys, (F.col("_b") * block + F.col("_p")).alias("g"), F.col("_z.f").alias("f"), F.col("_z.p").alias("p"), "_has")
    if top > bound:
        flat = flat.groupBy(*keys, "g").agg(F.sum("f").alias("f"), F.sum("p").alias("p"), F.max("_has").alias("_has"))
    return flat.select(*keys, "g", "f", F.when(F.col("_has"), F.col("p")).alias("p"))


def slope_wedges(points: DataFrame, category: str, rank: Column, floor_hz: float) -> DataFrame:
    """Median P/F per category, wedge bounds between neighbours, and the share inside its own wedge.

    ``rank`` gives the fixed order of the categories; bounds are geometric means of neighbouring
    medians, open below for the first and above for the last.
    """
    live = points.where(F.col("f") >= floor_hz).select(category, (F.col("p") / F.col("f")).alias("_s"))
    live = materialize(live)  # read for the medians and for the shares
    med = quantiles(live, [category], "_s", {"median_slope": 0.5}, pinned=True).withColumn("_r", rank)
    w = Window.orderBy("_r")  # one row per category
    edges = (
        med.withColumn("lo", F.coalesce(F.sqrt(F.col("median_slope") * F.lag("median_slope").over(w)), F.lit(0.0)))
        .withColumn("hi", F.coalesce(F.sqrt(F.col("median_slope") * F.lead("median_slope").over(w)),
                                     F.lit(float("inf"))))
    )
    inside = F.when((F.col("_s") >= F.col("lo")) & (F.col("_s") < F.col("hi")), 1.0).otherwise(0.0)
    return attach(live, edges, [category]).groupBy(category).agg(
        F.max("median_slope").alias("median_slope"), F.max("lo").alias("lo"), F.max("hi").alias("hi"),
        F.count(F.lit(1)).alias("n_points"), (F.avg(inside) * 100).alias("pct_own"))
