"""Per-waveform transforms and measures: one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dischargelab.functions import arrays as A


def dct_highpass(df: DataFrame, n_low: int, x: str = "x", out: str | None = None) -> DataFrame:
    """Remove the ``n_low`` slowest cosines; ``n_low <= 0`` changes nothing, and a waveform has no more than its length."""
    if n_low <= 0:
        return df if out in (None, x) else df.withColumn(out, F.col(x))
    rows = df.withColumn("_c", F.slice(A.dct_low(x, n_low), F.lit(1), F.greatest(F.size(x), F.lit(1))))
    return rows.withColumn(out or x, A.dct_remove(x, "_c")).drop("_c")


def drift(df: DataFrame, n_terms: int = 3, max_frac: float = 0.7, x: str = "x") -> DataFrame:
    """Energy share of the low cosines; a waveform survives at or below ``max_frac``."""
    energy = A.sum_sq(x)
    frac = F.when(energy > 0, A.sum_sq(A.dct_low(x, n_terms)) / energy).otherwise(F.lit(1.0))
    return df.withColumn("low_frac", frac).withColumn("survived", F.col("low_frac") <= max_frac)


def onset_offset(df: DataFrame, x: str = "x", edge_frac: float = 0.1, k: float = 2.5) -> DataFrame:
    """First and last sample that leaves the baseline band measured on the window edges."""
    n = F.size(x)
    edge = F.greatest(F.floor(n * edge_frac), F.lit(1)).cast("int")
    rows = df.withColumn("_b", F.concat(F.slice(x, F.lit(1), edge), F.slice(x, n - edge + 1, edge)))
    rows = rows.withColumn("baseline", A.mean("_b"))
    sd = A.let(F.col("baseline"), lambda m: F.sqrt(A.sum_sq(F.transform("_b", lambda v: v - m)) / F.size("_b")))
    band = F.struct(F.col("baseline").alias("m"), F.greatest(sd * k, F.lit(1e-9)).alias("thr"))
    rows = rows.withColumn("_a", A.let(band, lambda s: F.filter(F.transform(
        x, lambda v, i: F.when(F.abs(v - s["m"]) > s["thr"], i)), lambda i: i.isNotNull())))
    return (rows.withColumn("onset", F.coalesce(F.array_min("_a"), F.lit(0)))
            .withColumn("offset", F.coalesce(F.array_max("_a"), n - 1)).drop("_b", "_a"))


def amplitude_duration(df: DataFrame, fs: float, x: str = "x", frac: float = 0.5) -> DataFrame:
    """Peak-to-peak amplitude, width at ``frac`` of the largest deflection (ms), and its sign."""
    rows = df.withColumn("_p", A.argmax_first(F.transform(x, lambda v: F.abs(v))))
    rows = rows.withColumn("_pv", F.col(x)[F.col("_p")])
    rows = rows.withColumn("polarity", F.when(F.col("_pv") >= 0, 1.0).otherwise(-1.0))
    peak = F.struct(F.col("_p").alias("p"), F.col("polarity").alias("s"), (F.abs("_pv") * frac).alias("level"))

    def fails(side) -> Column:
        return A.let(peak, lambda k: F.transform(
            x, lambda v, i: F.when(side(i, k["p"]) & (v * k["s"] < k["level"]), i)))

    left = F.coalesce(F.array_max(fails(lambda i, p: i < p)), F.lit(0))
    right = F.coalesce(F.array_min(fails(lambda i, p: i > p)), F.size(x) - 1)
    return (rows.withColumn("amplitude", F.array_max(x) - F.array_min(x))
            .withColumn("duration_ms", (right - left) / fs * 1000.0).drop("_p", "_pv"))


def muap_metrics(df: DataFrame, fs: float, x: str = "x", k: float = 2.5, turn_frac: float = 0.05) -> DataFrame:
    """Standard motor-unit parameters of a waveform.

    Turns are a left fold with hysteresis: an extreme is tracked until the signal moves back from
    it by more than the threshold.
    """
    rows = onset_offset(df, x, k=k)
    rows = rows.withColumn("_s", F.slice(x, F.col("onset") + 1, F.col("offset") - F.col("onset") + 1))
    rows = (rows.withColumn("amp_max", F.array_max("_s")).withColumn("amp_min", F.array_min("_s"))
            .withColumn("amplitude", F.col("amp_max") - F.col("amp_min"))
            .withColumn("duration_ms", (F.col("offset") - F.col("onset")) / fs * 1000.0))
    n = F.size("_s")
    rows = rows.withColumn("_g", A.let(F.col("baseline"), lambda m: F.transform(
        "_s", lambda v: F.when(v - m < 0, -1).otherwise(1))))
    flips = F.zip_with(F.slice("_g", F.lit(1), n - 1), F.slice("_g", F.lit(2), n - 1),
                       lambda a, b: F.when(a != b, 1).otherwise(0))
    rows = rows.withColumn("phases", F.aggregate(flips, F.lit(1), lambda s, v: s + v))
    thr = F.greatest(F.col("amplitude") * turn_frac, F.lit(1e-9))

    def fold(s, v):
        d = v - s["last"]
        thr = s["thr"]
        start = (s["dir"] == 0) & (F.abs(d) > thr)
        turn = ((s["dir"] > 0) & (d < -thr)) | ((s["dir"] < 0) & (d > thr))
        extend = ((s["dir"] > 0) & (d > 0)) | ((s["dir"] < 0) & (d < 0))
        return F.struct(
            F.when(start | turn | extend, v).otherwise(s["last"]).alias("last"),
            F.when(start, F.when(d > 0, 1).otherwise(-1)).when(turn, -s["dir"]).otherwise(s["dir"]).alias("dir"),
            (s["turns"] + F.when(turn, 1).otherwise(0)).alias("turns"), thr.alias("thr"))

    init = F.struct(F.col("_s")[0].alias("last"), F.lit(0).alias("dir"), F.lit(0).alias("turns"), thr.alias("thr"))
    rows = rows.withColumn("turns", F.aggregate(F.slice("_s", F.lit(2), n - 1), init, fold, lambda s: s["turns"]))
    trap = A.total(F.zip_with(F.slice("_s", F.lit(1), n - 1), F.slice("_s", F.lit(2), n - 1),
                              lambda a, b: (F.abs(a) + F.abs(b)) * 0.5))
    return rows.withColumn("area", trap * (1000.0 / fs)).drop("_s", "_g")
