"""Type templates: comparison, merging and superposition tests.

Everything after ``templates`` works on one row per type. Pair tables are part of the result and
their size is types squared, independent of the number of spikes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.functions import arrays as A
from dischargelab.operators.linkage import components, relabel_groups
from dischargelab.session import attach, materialize


def templates(waves: DataFrame, keys: list[str], label: str = "label", x: str = "x") -> DataFrame:
    """(keys, label, n, m): mean waveform per type, combined map-side, waveforms never regrouped."""
    out = waves.withColumn("_v", array_to_vector(x)).groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_v")).alias("_m"))
    return out.select(*keys, label, "n", vector_to_array("_m").alias("m"))


def pair_l2(tpl: DataFrame, keys: list[str], normalize: bool = False, label: str = "label") -> DataFrame:
    """L2 distance of every unordered type pair, raw or after unit-area scaling."""
    m = A.normalize_area("m") if normalize else F.col("m")
    base = tpl.select(*keys, F.col(label).alias("type"), "n", m.alias("m"))
    a = base.select(*keys, F.col("type").alias("type_a"), F.col("n").alias("n_a"), F.col("m").alias("ma"))
    b = base.select(*keys, F.col("type").alias("type_b"), F.col("n").alias("n_b"), F.col("m").alias("mb"))
    on = [F.col("type_a") < F.col("type_b")]
    if keys:
        b = b.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
        on += [F.col(k) == F.col(f"_r_{k}") for k in keys]
    return a.join(b, on).select(*keys, "type_a", "type_b", "n_a", "n_b", A.l2("ma", "mb").alias("l2"))


def sorted_l2(pairs: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("l2", "type_a", "type_b")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long"))


def percentile_threshold(pairs: DataFrame, keys: list[str], p: float) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.percentile("l2", F.lit(p / 100.0)).alias("threshold"))


def elbow_threshold(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Midpoint of the largest gap between consecutive distances; NULL below two pairs."""
    w = Window.partitionBy(*keys).orderBy("l2", "type_a", "type_b")
    g = pairs.withColumn("_nx", F.lead("l2").over(w)).withColumn("_rk", F.row_number().over(w))
    best = F.max(F.when(F.col("_nx").isNotNull(), F.struct(
        (F.col("_nx") - F.col("l2")).alias("gap"), (-F.col("_rk")).alias("nrk"),
        ((F.col("l2") + F.col("_nx")) / 2).alias("mid"))))
    return g.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.mid").alias("threshold"))


def fence_threshold(pairs: DataFrame, keys: list[str], k: float = 2.0) -> DataFrame:
    """max(median - k*MAD, 0) of the distances; NULL below two pairs."""
    w = Window.partitionBy(*keys)
    rows = pairs.withColumn("_md", F.percentile("l2", F.lit(0.5)).over(w))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.min("l2").alias("l2_min"),
                                  F.max("_md").alias("l2_median"),
                                  F.percentile(F.abs(F.col("l2") - F.col("_md")), F.lit(0.5)).alias("l2_mad"))
    fence = F.greatest(F.col("l2_median") - F.col("l2_mad") * k, F.lit(0.0))
    return out.withColumn("threshold", F.when(F.col("n_pairs") >= 2, fence))


def choose_threshold(pairs: DataFrame, keys: list[str], explicit: float | None = None,
                     percentile: float | None = None, elbow: bool = False,
                     fence_k: float | None = None) -> DataFrame:
    """Threshold by precedence: explicit, percentile, elbow, fence; NULL leaves types alone."""
    runs = pairs.select(*keys).distinct() if keys else pairs.select(F.lit(1).alias("_one")).distinct()
    options = []
    if explicit is not None:
        options = [runs.select(*keys, F.lit(float(explicit)).alias("threshold"))]
    elif percentile:
        options = [percentile_threshold(pairs, keys, percentile)]
    else:
        options += [elbow_threshold(pairs, keys)] if elbow else []
        options += [fence_threshold(pairs, keys, fence_k).select(*keys, "threshold")] if fence_k is not None else []
    if not options:
        return runs.select(*keys, F.lit(None).cast("double").alias("threshold"))
    out = options[0]
    for nxt in options[1:]:
        nxt = nxt.withColumnRenamed("threshold", "_t2")
        out = out.join(nxt, keys) if keys else out.crossJoin(nxt)  # one row each
        out = out.select(*keys, F.coalesce("threshold", "_t2").alias("threshold"))
    return out


def close_pairs(pairs: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs at or below a positive threshold of their run."""
    t = thresholds.select(*keys, "threshold")
    rows = attach(pairs, t, keys)
    return rows.where((F.col("threshold") > 0) & (F.col("l2") <= F.col("threshold"))).drop("threshold")


def l2_merge(waves: DataFrame, keys: list[str], normalize: bool = False, label: str = "label", x: str = "x",
             **options) -> DataFrame:
    """Relabel types whose templates are close; no spike is dropped, labels are not renumbered."""
    pairs = materialize(pair_l2(templates(waves, keys, label, x), keys, normalize, label))
    close = close_pairs(pairs, choose_threshold(pairs, keys, **options), keys)
    return relabel_groups(waves, components(close, keys), keys, label)


def l2_merge_stage(waves: DataFrame, keys: list[str], fs: float, window_ms: float = 3.0, fence_k: float = 3.0,
                   normalize: bool = True, label: str = "label", x: str = "x") -> DataFrame:
    """Shape merge on the waveform core: crop, unit-area scaling, low-outlier fence.

    With fewer than three types a run has fewer than two pairs, the fence is NULL and nothing merges.
    """
    half = int(round(window_ms * 1e-3 * fs))
    core = waves.withColumn(x, A.crop_center(x, half))
    pairs = materialize(pair_l2(templates(core, keys, label, x), keys, normalize, label))
    close = close_pairs(pairs, fence_threshold(pairs, keys, fence_k), keys)
    return relabel_groups(waves, components(close, keys), keys, label)


# --- superposition ------------------------------------------------------------------------------

def effective_rank(tpl: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """Singular values of the templates scaled by sqrt(n) against the noise ceiling."""
    base = tpl if keys else tpl.withColumn("_all", F.lit(0))
    by = keys or ["_all"]

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["m"].to_list()) * np.sqrt(np.maximum(pdf["n"].to_numpy(), 1.0))[:, None]
        sv = np.linalg.svd(m, compute_uv=False)
        ceiling = sigma * (np.sqrt(m.shape[0]) + np.sqrt(m.shape[1]))
        row = {k: [pdf[k].iloc[0]] for k in keys}
        row.update(n_types=[m.shape[0]], n_significant=[int((sv > ceiling).sum())], noise_ceiling=[ceiling],
                   energy=[float((sv ** 2).sum())], singular_values=[sv])
        return pd.DataFrame(row)

    types = {f.name: f.dataType.simpleString() for f in tpl.schema.fields}
    head = "".join(f"{k} {types[k]}, " for k in keys)
    return base.groupBy(*by).applyInPandas(
        rank, head + "n_types long, n_significant long, noise_ceiling double, energy double, singular_values array<double>")


def best_single_fit(tpl: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """For each type the other template that explains it best with one non-negative factor."""
    c = tpl.select(*keys, F.col(label).alias("type_c"), F.col("m").alias("mc"))
    i = tpl.select(*keys, F.col(label).alias("type_i"), F.col("m").alias("mi"))
    rows = (c.join(i, keys) if keys else c.crossJoin(i)).where("type_c <> type_i")  # types x types
    den = A.sum_sq("mi")
    rows = rows.withColumn("coef", F.when(den > 0, F.greatest(A.dot("mc", "mi") / den, F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("residual", A.minus("mc", A.scale("mi", F.col("coef"))))
    rows = rows.withColumn("residual_frac", F.sqrt(A.sum_sq("residual")) / (F.sqrt(A.sum_sq("mc")) + 1e-12))
    w = Window.partitionBy(*keys, "type_c").orderBy("residual_frac", "type_i")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def superposition(tpl: DataFrame, keys: list[str], max_shift: int, min_improvement: float = 0.15,
                  max_residual: float = 0.25, label: str = "label") -> DataFrame:
    """Types that are a time-shifted sum of two others.

    The leftover of the best single fit is matched against every other template at every shift;
    the first best shift enters a joint two-template least squares in closed form, clipped at zero.
    """
    single = best_single_fit(tpl, keys, label)
    j = tpl.select(*keys, F.col(label).alias("type_j"), F.col("m").alias("mj"))
    rows = (single.join(j, keys) if keys else single.crossJoin(j)).where(  # types x types
        "type_j <> type_c and type_j <> type_i")
    s = F.least(F.lit(int(max_shift)), F.size("mj") - 1)
    rows = rows.withColumn("_s", F.sequence(-s, s))
    rows = rows.withColumn("_corr", F.transform("_s", lambda k: A.dot("residual", A.shift("mj", k))))
    rows = rows.withColumn("shift_samples", F.col("_s")[A.argmax_first("_corr")])
    rows = rows.withColumn("_w", A.shift("mj", F.col("shift_samples")))
    rows = (rows.withColumn("_a", A.sum_sq("mi")).withColumn("_b", A.dot("mi", "_w")).withColumn("_d", A.sum_sq("_w"))
            .withColumn("_p", A.dot("mi", "mc")).withColumn("_q", A.dot("_w", "mc")))
    det = F.col("_a") * F.col("_d") - F.col("_b") * F.col("_b")
    solvable = det > F.col("_a") * F.col("_d") * 1e-14
    # A singular pair has a minimum-norm solution along the shared direction.
    joint = F.col("_a") + F.col("_d")
    c1 = F.when(solvable, (F.col("_p") * F.col("_d") - F.col("_q") * F.col("_b")) / det).when(
        joint > 0, F.col("_p") / joint).otherwise(0.0)
    c2 = F.when(solvable, (F.col("_q") * F.col("_a") - F.col("_p") * F.col("_b")) / det).when(
        joint > 0, F.col("_q") / joint).otherwise(0.0)
    rows = rows.withColumn("coef_i", F.greatest(c1, F.lit(0.0))).withColumn("coef_j", F.greatest(c2, F.lit(0.0)))
    fit = F.zip_with(A.scale("mi", F.col("coef_i")), A.scale("_w", F.col("coef_j")), lambda p, q: p + q)
    rows = rows.withColumn("pair_residual_frac", F.sqrt(A.sum_sq(A.minus("mc", fit))) / (F.sqrt(A.sum_sq("mc")) + 1e-12))
    w = Window.partitionBy(*keys, "type_c").orderBy("pair_residual_frac", "type_j")
    best = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    best = best.withColumn("improvement", F.col("residual_frac") - F.col("pair_residual_frac"))
    return best.where((F.col("improvement") >= min_improvement) & (F.col("pair_residual_frac") <= max_residual)).select(
        *keys, "type_c", "type_i", "type_j", "shift_samples", "coef_i", "coef_j",
        F.col("residual_frac").alias("single_residual_frac"), "pair_residual_frac", "improvement")


def drop_superposition(waves: DataFrame, candidates: DataFrame, keys: list[str], label: str = "label",
                       min_types: int = 3) -> DataFrame:
    """Set composite types to -1 and renumber the rest; runs below ``min_types`` are left alone."""
    types = waves.select(*keys, label).where(F.col(label) >= 0).distinct()
    bad = candidates.select(*keys, F.col("type_c").alias(label)).distinct().withColumn("_bad", F.lit(True))
    run = Window.partitionBy(*keys)
    w = Window.partitionBy(*keys).orderBy(F.col("_bad").isNotNull(), label)
    marks = types.join(bad, keys + [label], "left").withColumn("_n", F.count(F.lit(1)).over(run))
    has = F.count("_bad").over(run)
    new = F.when((F.col("_n") < min_types) | (has == 0), F.col(label)).when(F.col("_bad").isNotNull(), F.lit(-1)).otherwise(
        F.row_number().over(w) - 1)
    remap = marks.withColumn("_new", new.cast("int")).select(*keys, label, "_new")
    rows = attach(waves, remap, keys + [label], "left")
    return rows.withColumn(label, F.coalesce("_new", label)).select(*waves.columns)
