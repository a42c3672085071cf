"""Feature construction: principal components, wavelet coefficients, scaling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.functions import arrays as A
from dischargelab.operators.ordered import quantiles
from dischargelab.session import attach


# --- principal components -----------------------------------------------------------------------

def _centre(waves: DataFrame, x: str) -> DataFrame:
    mean = waves.select(Summarizer.mean(array_to_vector(x)).alias("_m")).select(vector_to_array("_m").alias("_m"))
    return attach(waves, mean, []).withColumn(
        "_v", array_to_vector(A.minus(x, "_m"))).drop("_m")


def _fit_pca(centred: DataFrame, k: int):
    return PCA(k=k, inputCol="_v", outputCol="_o").fit(centred)


def _project(centred: DataFrame, model, k: int, out: str) -> DataFrame:
    """First ``k`` scores; the sign of a component makes its largest loading positive."""
    w = model.pc.toArray()
    sign = np.where(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])] < 0, -1.0, 1.0)[:k]
    scores = F.slice(vector_to_array("_o"), 1, k)
    return model.transform(centred).withColumn(out, F.zip_with(
        scores, F.array(*[F.lit(float(s)) for s in sign]), lambda v, s: v * s)).drop("_v", "_o")


def pca_scores(waves: DataFrame, k: int, x: str = "x", out: str = "shape") -> DataFrame:
    """Centred principal-component scores; the covariance is one distributed aggregation."""
    n, length = waves.agg(F.count(F.lit(1)), F.max(F.size(x))).first()
    centred = _centre(waves, x)
    k = min(k, n, length)
    return _project(centred, _fit_pca(centred, k), k, out)


def pca_by_variance(waves: DataFrame, var_frac: float = 0.9, max_pc: int = 10, x: str = "x",
                    out: str = "shape") -> tuple[DataFrame, int]:
    """Scores on the leading components up to ``var_frac`` of the variance, 2 to ``max_pc`` of them."""
    n, length = waves.agg(F.count(F.lit(1)), F.max(F.size(x))).first()
    centred = _centre(waves, x)
    model = _fit_pca(centred, min(n, length))
    share = np.cumsum(model.explainedVariance.toArray())
    n_pc = int(np.clip(np.searchsorted(share, var_frac) + 1, 2, min(max_pc, len(share))))
    return _project(centred, model, n_pc, out), n_pc


# --- wavelets -----------------------------------------------------------------------------------

# Decomposition low-pass taps of the symlet family.
SYMLETS = {
    "sym2": [-0.12940952255092145, 0.22414386804185735, 0.836516303737469, 0.48296291314469025],
    "sym4": [-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161,
             0.29785779560527736, -0.09921954357684722, -0.012603967262037833, 0.0322231006040427],
}


def wavelet_level(length: int, wavelet: str, level: int | None) -> int:
    top = int(np.floor(np.log2(length / (len(SYMLETS[wavelet]) - 1)))) if length >= len(SYMLETS[wavelet]) - 1 else 0
    return max(top, 0) if level is None else level


def dwt(x: np.ndarray, wavelet: str, level: int) -> np.ndarray:
    """Rows of ``x`` decomposed with half-sample symmetric padding; coarsest coefficients first."""
    lo = np.asarray(SYMLETS[wavelet])
    taps = len(lo)
    hi = lo[::-1] * np.where(np.arange(taps) % 2 == 0, -1.0, 1.0)
    parts, a = [], x
    for _ in range(level):
        n = a.shape[1]
        half = (n + taps - 1) // 2
        pos = (2 * np.arange(half) + 1)[:, None] - np.arange(taps)[None, :]
        pos = np.mod(pos, 2 * n)
        pos = np.where(pos < n, pos, 2 * n - 1 - pos)
        win = a[:, pos]
        parts.append(win @ hi)
        a = win @ lo
    return np.concatenate([a] + parts[::-1], axis=1)


def wavelet_coefficients(waves: DataFrame, wavelet: str = "sym2", level: int | None = None, x: str = "x",
                         out: str = "coef") -> DataFrame:
    @F.pandas_udf("array<double>")
    def coefficients(col: pd.Series) -> pd.Series:
        if not len(col):
            return col
        m = np.stack(col.to_list()).astype(float)
        return pd.Series(list(dwt(m, wavelet, wavelet_level(m.shape[1], wavelet, level))))

    return waves.withColumn(out, coefficients(x))


def normality_k2(n: Column, skew: Column, kurt_excess: Column) -> Column:
    """D'Agostino-Pearson K^2 from biased skewness and excess kurtosis."""
    y = skew * F.sqrt(((n + 1) * (n + 3)) / ((n - 2) * 6.0))
    beta2 = ((n * n + n * 27 - 70) * 3.0 * (n + 1) * (n + 3)) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt((beta2 - 1) * 2.0) - 1
    delta = F.lit(1.0) / F.sqrt(F.log(w2) * 0.5)
    alpha = F.sqrt(F.lit(2.0) / (w2 - 1))
    ya = F.when(y == 0, 1.0).otherwise(y) / alpha
    zs = delta * F.log(ya + F.sqrt(ya * ya + 1))
    b2 = kurt_excess + 3.0
    e = (n - 1) * 3.0 / (n + 1)
    var = n * 24.0 * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(var)
    sb = ((n * n - n * 5 + 2) * 6.0) / ((n + 7) * (n + 9)) * F.sqrt(((n + 3) * 6.0 * (n + 5)) / (n * (n - 2) * (n - 3)))
    a = (F.lit(8.0) / sb) * (F.lit(2.0) / sb + F.sqrt(F.lit(4.0) / (sb * sb) + 1)) + 6.0
    den = x * F.sqrt(F.lit(2.0) / (a - 4)) + 1
    term2 = F.signum(den) * F.pow((F.lit(1.0) - F.lit(2.0) / a) / F.abs(den), F.lit(1.0 / 3.0))
    zk = (F.lit(1.0) - F.lit(2.0) / (a * 9) - term2) / F.sqrt(F.lit(2.0) / (a * 9))
    return zs * zs + zk * zk


def discriminative_coefficients(coefs: DataFrame, sid: str, n_keep: int, clip: float = 1.0, coef: str = "coef",
                                keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Winsorized coefficients that look least Gaussian across the spikes of a pool.

    Returns (scores, kept): one scored row per coefficient, and one row per spike and kept
    coefficient with its rank. Percentiles and moments are aggregates over (coefficient, value).
    """
    keys = keys or []
    at = keys + ["j"]
    long = coefs.select(*keys, sid, F.posexplode(coef).alias("j", "v"))
    if clip > 0:
        lim = quantiles(long, at, "v", {"lo": clip / 100.0, "hi": 1 - clip / 100.0})
        long = attach(long, lim, at).withColumn("v", F.greatest(F.least("v", "hi"), "lo")).drop("lo", "hi")
    n = F.col("_n").cast("double")
    stats = long.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.skewness("v").alias("_s"),
                                  F.kurtosis("v").alias("_k"), (F.max("v") - F.min("v")).alias("_r"))
    scored = stats.select(*at, F.when(F.col("_r") == 0, 0.0).otherwise(
        normality_k2(n, F.col("_s"), F.col("_k"))).alias("k2"))
    w = Window.partitionBy(*keys).orderBy(F.col("k2").desc(), F.col("j").desc())  # one row per coefficient
    top = scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < n_keep).drop("k2")
    return scored, attach(long, top, at).select(*keys, sid, "j", "rank", "v")


def wavelet_features(waves: DataFrame, sid: str, n_keep: int, wavelet: str = "sym2", level: int | None = None,
                     clip: float = 1.0, x: str = "x", out: str = "shape", keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    _, kept = discriminative_coefficients(wavelet_coefficients(waves, wavelet, level, x), sid, n_keep, clip, keys=keys)
    packed = kept.groupBy(*keys, sid).agg(F.array_sort(F.collect_list(F.struct("rank", "v"))).alias("_p"))
    return waves.join(packed, keys + [sid]).withColumn(out, F.transform("_p", lambda s: s["v"])).drop("_p")


def pca_by_pool(waves: DataFrame, k: int, x: str = "x", out: str = "shape", pool: str = "g") -> DataFrame:
    """Principal-component scores fitted per pool, any number of pools at once.

    Counts, sums and outer-product sums are added per pool on the executors; the axes of a pool are
    solved from its one row of moments and joined back.
    """
    rows = waves.select(pool, x)

    def moments(batches):
        acc: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby(pool):
                m = np.stack(part[x].to_numpy())
                a = np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()])
                acc[g] = acc[g] + a if g in acc else a
        if acc:
            yield pd.DataFrame({pool: list(acc), "a": list(acc.values())})

    kind = waves.schema[pool].dataType.simpleString()
    total = rows.mapInPandas(moments, f"{pool} {kind}, a array<double>").withColumn("a", array_to_vector("a")).groupBy(pool).agg(
        vector_to_array(Summarizer.sum(F.col("a"))).alias("_a"))

    @F.pandas_udf("array<double>")
    def axes(col: pd.Series) -> pd.Series:
        res = []
        for a in col:
            a = np.asarray(a)
            d = int(round((-1 + np.sqrt(4 * len(a) - 3)) / 2))
            n, s, ss = a[0], a[1:1 + d], a[1 + d:].reshape(d, d)
            _, vec = np.linalg.eigh(ss - np.outer(s, s) / n)
            w = vec[:, ::-1][:, :min(k, d, int(n))]
            w = w * np.where(w[np.abs(w).argmax(0), np.arange(w.shape[1])] < 0, -1.0, 1.0)
            res.append(np.concatenate([s / n, w.ravel()]))
        return pd.Series(res)

    @F.pandas_udf("array<double>")
    def project(v: pd.Series, ax: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(r) - a[:len(r)]) @ a[len(r):].reshape(len(r), -1)
                          for r, a in zip(v, map(np.asarray, ax))])

    fitted = total.select(pool, axes("_a").alias("_ax"))
    return attach(waves, fitted, [pool]).withColumn(out, project(x, "_ax")).drop("_ax")


# --- assembly -----------------------------------------------------------------------------------

def assemble(df: DataFrame, n_shape: int, amp_dur_weight: float = 0.0, polarity_weight: float = 1.0,
             shape: str = "shape", out: str = "features", keys: list[str] | None = None) -> DataFrame:
    """Standardize shape, amplitude, duration and polarity together (population std, constant
    columns to zero), then weight the last three."""
    keys = keys or []
    names = [f"_f{j}" for j in range(n_shape + 3)]
    raw = [F.col(shape)[j] for j in range(n_shape)] + [F.col("amplitude"), F.col("duration_ms"), F.col("polarity")]
    rows = df.select("*", *[c.cast("double").alias(n) for n, c in zip(names, raw)])
    agg = [F.avg(n).alias(f"_m{n}") for n in names] + [F.stddev_pop(n).alias(f"_s{n}") for n in names]
    stats = rows.groupBy(*keys).agg(*agg)
    rows = attach(rows, stats, keys)
    weight = [1.0] * n_shape + [amp_dur_weight, amp_dur_weight, polarity_weight]
    # A constant column has a standard deviation of rounding size only.
    z = [F.when(F.col(f"_s{n}") > F.abs(F.col(f"_m{n}")) * 1e-14, (F.col(n) - F.col(f"_m{n}")) / F.col(f"_s{n}"))
         .otherwise(0.0) * w for n, w in zip(names, weight)]
    return rows.withColumn(out, F.array(*z)).drop(*names, *[f"_m{n}" for n in names], *[f"_s{n}" for n in names])
