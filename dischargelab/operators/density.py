"""Density estimates and small summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.session import attach


def kde_2d(points: DataFrame, key: str, x: str, y: str, n_grid: int, weight: str | None = None, pad: float = 0.2) -> DataFrame:
    """(key, gx, gy, x, y, density): Gaussian kernel density per key on its own padded grid.

    Scott bandwidth on the effective sample size, weighted covariance. Every task adds its points
    onto the fixed-size grids it meets and emits at most keys x n_grid^2 partial sums, so points are
    neither expanded nor gathered. Keys with fewer than three points or no extent are left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = points.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w"))
    rows = rows.where("x is not null and y is not null and w > 0")
    sums = rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"),
        (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    sums = sums.where("n >= 3 and x1 > x0 and y1 > y0")
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    cov = attach(rows, sums, ["k"]).groupBy("k").agg(
        F.sum(F.col("w") * dx * dx).alias("cxx"), F.sum(F.col("w") * dx * dy).alias("cxy"), F.sum(F.col("w") * dy * dy).alias("cyy"))
    spec = {}
    for r in sums.join(cov, "k").collect():  # one row per key
        unbias = r["sw"] - r["sw2"] / r["sw"]
        factor = (r["sw"] ** 2 / r["sw2"]) ** (-1.0 / 6.0)
        c = np.array([[r["cxx"], r["cxy"]], [r["cxy"], r["cyy"]]]) / unbias * factor ** 2
        if np.linalg.det(c) <= 0:
            continue
        px, py = pad * (r["x1"] - r["x0"] + 1e-9), pad * (r["y1"] - r["y0"] + 1e-9)
        gx = np.linspace(r["x0"] - px, r["x1"] + px, n_grid)
        gy = np.linspace(max(0.0, r["y0"] - py), r["y1"] + py, n_grid)
        spec[r["k"]] = (gx, gy, np.linalg.inv(c), 1.0 / (2 * np.pi * math.sqrt(np.linalg.det(c)) * r["sw"]))
    key_type = points.schema[key].dataType.simpleString()

    def add(batches):
        acc = {}
        for pdf in batches:
            for k, part in pdf.groupby("k"):
                if k not in spec:
                    continue
                gx, gy, inv, _ = spec[k]
                grid = acc.setdefault(k, np.zeros((n_grid, n_grid)))
                for s in range(0, len(part), 64):
                    p = part.iloc[s:s + 64]
                    ux = gx[None, :, None] - p["x"].to_numpy()[:, None, None]
                    uy = gy[None, None, :] - p["y"].to_numpy()[:, None, None]
                    q = inv[0, 0] * ux * ux + 2 * inv[0, 1] * ux * uy + inv[1, 1] * uy * uy
                    grid += (np.exp(-0.5 * q) * p["w"].to_numpy()[:, None, None]).sum(0)
        for k, grid in acc.items():
            ix, iy = np.meshgrid(np.arange(n_grid), np.arange(n_grid), indexing="ij")
            yield pd.DataFrame({"k": k, "gx": ix.ravel(), "gy": iy.ravel(), "s": grid.ravel()})

    parts = rows.mapInPandas(add, f"k {key_type}, gx int, gy int, s double")
    total = parts.groupBy("k", "gx", "gy").agg(F.sum("s").alias("s"))
    if not spec:
        return total.select(F.col("k").alias(key), "gx", "gy", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "s").withColumnRenamed("s", "density")
    scale = F.create_map(*[v for k, sp in spec.items() for v in (F.lit(k), F.array(
        F.lit(float(sp[0][0])), F.lit(float(sp[0][-1])), F.lit(float(sp[1][0])), F.lit(float(sp[1][-1])), F.lit(float(sp[3]))))])
    s = scale[F.col("k")]
    at = lambda lo, hi, g: s[lo] + (s[hi] - s[lo]) * F.col(g) / float(n_grid - 1)
    return total.select(F.col("k").alias(key), "gx", "gy", at(0, 1, "gx").alias("x"), at(2, 3, "gy").alias("y"),
                        (F.col("s") * s[4]).alias("density"))


def histogram(points: DataFrame, value: str, n_bins: int) -> DataFrame:
    """(bin, lo, hi, n) on equal bins from minimum to maximum; the last bin is closed, empty bins count zero."""
    span = points.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    rows = points.select(value).where(F.col(value).isNotNull()).crossJoin(F.broadcast(span))  # one row on the right
    width = (F.col("_b") - F.col("_a")) / n_bins
    b = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_a")) / width), F.lit(n_bins - 1))).otherwise(0)
    counts = rows.groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = F.sequence(F.lit(0).cast("long"), F.when(width > 0, F.lit(n_bins - 1)).otherwise(0).cast("long"))
    grid = span.where("_a IS NOT NULL").select("_a", width.alias("_w"), F.explode(bins).alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("_a") + F.col("bin") * F.col("_w")).alias("lo"), (F.col("_a") + (F.col("bin") + 1) * F.col("_w")).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def kde_1d(points: DataFrame, value: str, n_points: int, scale: float | None = None) -> DataFrame:
    """(g, x, density) between minimum and maximum; empty below two points or without extent.

    Partial sums per task on the fixed grid. ``scale`` multiplies the density, e.g. by n * bin width.
    """
    st = points.agg(F.count(value).alias("n"), F.min(value).alias("a"), F.max(value).alias("b"), F.stddev_samp(value).alias("s")).first()
    schema = "g int, s double"
    if st["n"] < 2 or not st["b"] > st["a"]:
        return points.limit(0).select(F.lit(0).alias("g"), F.lit(0.0).alias("x"), F.lit(0.0).alias("density"))
    grid = np.linspace(st["a"], st["b"], n_points)
    h = st["s"] * st["n"] ** -0.2

    def add(batches):
        acc = np.zeros(n_points)
        for pdf in batches:
            v = pdf["v"].to_numpy()
            for s in range(0, len(v), 2048):
                acc += np.exp(-0.5 * ((grid[:, None] - v[None, s:s + 2048]) / h) ** 2).sum(1)
        yield pd.DataFrame({"g": np.arange(n_points), "s": acc})

    parts = points.select(F.col(value).cast("double").alias("v")).where("v is not null").mapInPandas(add, schema)
    norm = (scale or 1.0) / (st["n"] * h * math.sqrt(2 * math.pi))
    step = (st["b"] - st["a"]) / (n_points - 1)
    return parts.groupBy("g").agg((F.sum("s") * norm).alias("density")).select("g", (F.lit(float(st["a"])) + F.col("g") * step).alias("x"), "density")


def covariance_ellipse(points: DataFrame, keys: list[str], x: str, y: str, n_std: float = 2.0) -> DataFrame:
    """Center, width, height and angle of the ``n_std`` covariance ellipse; NULL below two points."""
    st = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("_a"),
        F.covar_samp(x, y).alias("_b"), F.var_samp(y).alias("_c"))
    half, mid = (F.col("_a") - F.col("_c")) / 2, (F.col("_a") + F.col("_c")) / 2
    root = F.sqrt(half * half + F.col("_b") * F.col("_b"))
    l1, l2 = mid + root, mid - root
    # Major-axis direction; only its line matters, so the angle is taken in (-90, 90].
    ang = F.degrees(F.atan2(F.col("_b") * 2, F.col("_a") - F.col("_c")) / 2)
    ok = (F.col("n") >= 2) & (l2 >= 0)
    return st.select(*keys, "n", "cx", "cy", F.when(ok, F.sqrt(l1) * (2 * n_std)).alias("width"),
                     F.when(ok, F.sqrt(F.greatest(l2, F.lit(0.0))) * (2 * n_std)).alias("height"), F.when(ok, ang).alias("angle"))


def category(subject: Column) -> Column:
    return F.initcap(F.substring_index(subject, "_", -1))


def runs_present(spikes: DataFrame, run: str, label: str = "label") -> DataFrame:
    return spikes.groupBy(label).agg(F.countDistinct(run).alias("n_runs_present"), F.count(F.lit(1)).alias("n_spikes"))


def curated_keep(types: DataFrame, keep: DataFrame, subject: str = "subject", type_idx: str = "type_idx") -> DataFrame:
    """Types on their subject's keep list; a subject without a list keeps all its types."""
    listed = keep.select(subject).distinct().withColumn("_has", F.lit(True))
    wanted = keep.select(subject, type_idx).distinct().withColumn("_ok", F.lit(True))
    rows = attach(attach(types, listed, [subject], "left"), wanted, [subject, type_idx], "left")
    return rows.where(F.col("_has").isNull() | F.col("_ok").isNotNull()).drop("_has", "_ok")


def library_ordinal(types: DataFrame, order: list[str]) -> DataFrame:
    """1-based number of every library entry, in archive order (one row per entry)."""
    return types.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)).cast("long"))


# --- text reports -------------------------------------------------------------------------------

def linked_lines(pairs: DataFrame) -> DataFrame:
    text = F.format_string("type %d (n=%d) <-> type %d (n=%d): co-occurrence %.0f%%/%.0f%%, latency %+.2f +/- %.2f ms "
                           "(type %d is the likely secondary lobe)", "type_a", "n_a", "type_b", "n_b", F.col("co_ab") * 100,
                           F.col("co_ba") * 100, "latency_mean_ms", "latency_std_ms", "dependent_type")
    return pairs.select("type_a", "type_b", text.alias("line"))


def close_lines(pairs: DataFrame) -> DataFrame:
    text = F.format_string("type %d (n=%d) <-> type %d (n=%d): L2 distance %.2f", "type_a", "n_a", "type_b", "n_b", "l2")
    return pairs.select("type_a", "type_b", text.alias("line"))


def superposition_lines(cands: DataFrame, fs: float | None = None) -> DataFrame:
    shift = F.format_string("%d samples", "shift_samples")
    if fs:
        shift = F.concat(shift, F.format_string(" (%+.2f ms)", F.col("shift_samples") / fs * 1000.0))
    text = F.concat(F.format_string("type %d ~= %.2f*type%d + %.2f*type%d shifted ", "type_c", "coef_i", "type_i", "coef_j", "type_j"),
                    shift, F.format_string(": residual %.0f%% (single) -> %.0f%% (pair), improvement %.0f%%",
                                           F.col("single_residual_frac") * 100, F.col("pair_residual_frac") * 100, F.col("improvement") * 100))
    return cands.select("type_c", text.alias("line"))
