"""Operators from sampled traces to detected spikes and cut waveforms.

A trace is (keys, i, v) with a dense 0-based sample index. Work is split into (run, block) groups
with halo (operators/blocks.py), so neither a long run nor a hot one lands in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dischargelab.functions import arrays as A
from dischargelab.functions.filters import morlet_power, zero_phase
from dischargelab.operators import packed as PK
from dischargelab.operators.blocks import BLK, OWN, block_window, chunks, with_halo
from dischargelab.operators.ordered import neighbours, quantiles
from dischargelab.operators.templates import templates
from dischargelab.operators.trains import min_isi
from dischargelab.session import attach, materialize

BLOCK = 4096


# --- filtering ----------------------------------------------------------------------------------

def _filter(trace: DataFrame, keys: list[str], fs: float, kind: str, low: float, high: float | None, size: int | None) -> DataFrame:
    """Zero-phase filter of every run, by blocks whose states are scanned."""
    packed = materialize(PK.pack(trace, keys, size or PK.SIZE))
    return PK.unpack(PK.zero_phase_blocks(packed, keys, kind, low, high, fs), keys)


def bandpass(trace: DataFrame, keys: list[str], fs: float, low: float, high: float, size: int | None = None) -> DataFrame:
    return _filter(trace, keys, fs, "bandpass", low, high, size)


def highpass(trace: DataFrame, keys: list[str], fs: float, cutoff: float, size: int | None = None) -> DataFrame:
    return _filter(trace, keys, fs, "highpass", cutoff, None, size)


def rectify(trace: DataFrame) -> DataFrame:
    return trace.withColumn("v", F.abs("v"))


def smooth_width(ms: float, fs: float) -> int:
    return max(1, int(round(ms * 1e-3 * fs)))


def envelope(trace: DataFrame, keys: list[str], width: int, size: int = BLOCK) -> DataFrame:
    """Moving average that treats samples outside the run as zero; an even window leans back."""
    back, ahead = width // 2, width - 1 - width // 2
    w = block_window(keys).rowsBetween(-back, ahead)
    rows = with_halo(trace.select(*keys, "i", "v"), size, back, ahead)
    return rows.withColumn("v", F.sum("v").over(w) / width).where(OWN).select(*keys, "i", "v")


def mad_threshold(env: DataFrame, keys: list[str], k: float, baseline_samples: int | None = None) -> DataFrame:
    """Noise level (median/0.6745, optionally of a quiet lead-in) and detection threshold per run."""
    quiet = env if baseline_samples is None else env.where(F.col("i") < baseline_samples)
    return quantiles(quiet.select(*keys, "v"), keys, "v", {"_m": 0.5}).select(
        *keys, (F.col("_m") / 0.6745).alias("sigma"), (F.col("_m") / 0.6745 * k).alias("threshold"))


# --- peaks --------------------------------------------------------------------------------------

def local_maxima(env: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """(keys, i, v) of strict local maxima; a flat top counts once, at its midpoint."""
    w = block_window(keys)
    rows = (with_halo(env.select(*keys, "i", "v"), size, 1, 1)
            .withColumn("_a", F.lag("v").over(w)).withColumn("_b", F.lead("v").over(w)).where(OWN))
    rises = F.col("v") > F.col("_a")
    sharp = rises & (F.col("v") > F.col("_b"))
    starts = rises & (F.col("v") == F.col("_b"))
    ends = (F.col("v") == F.col("_a")) & (F.col("_b").isNull() | (F.col("v") != F.col("_b")))
    kind = F.when(sharp, "peak").when(starts, "start").when(ends, "end")
    marks = rows.select(*keys, "i", "v", kind.alias("_k"), (F.col("v") > F.col("_b")).alias("_falls")).where("_k is not null")
    return maxima_of(marks, keys)


def maxima_of(marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, v): single maxima, and the midpoints of flat stretches that fall behind their end."""
    marks = neighbours(marks, keys, ["i"], nxt={"_e": F.when(F.col("_k") == "end", F.struct("i", "_falls"))})
    top = F.when(F.col("_k") == "peak", F.col("i")).when(
        (F.col("_k") == "start") & F.col("_e._falls"), F.floor((F.col("i") + F.col("_e.i")) / 2))
    return marks.select(*keys, top.cast("long").alias("i"), "v").where(F.col("i").isNotNull())


def envelope_peaks(env: DataFrame, thresholds: DataFrame, keys: list[str], distance: int, size: int = BLOCK) -> DataFrame:
    """Local maxima at or above the threshold, thinned highest-first to the minimum distance.

    Of equally high peaks the later one is visited first.
    """
    return thinned(attach(local_maxima(env, keys, size), thresholds.select(*keys, "threshold"), keys).where("v >= threshold"), keys, distance)


def thinned(high: DataFrame, keys: list[str], distance: int) -> DataFrame:
    high = high.select(*keys, "i", "v", (-F.col("i").cast("double")).alias("_t"))
    kept = min_isi(high, keys, float(distance), t="_t", amp="v", sid="i")
    return kept.where("keep").select(*keys, "i", "v")


def windows_at(trace: DataFrame, peaks: DataFrame, keys: list[str], before: int, after: int, size: int = BLOCK,
               at: str = "i") -> DataFrame:
    """``peaks`` with ``_lo`` and ``_w``: the samples [at-before, at+after), clipped to the run.

    Samples travel once per block as an array, and each peak slices its block's array.
    """
    packed = chunks(trace, keys, size, before, after).withColumnRenamed("v", "_v").withColumnRenamed("i0", "_i0")
    rows = peaks.withColumn(BLK, F.floor(F.col(at) / size)).join(packed, keys + [BLK])
    lo = F.greatest(F.col(at) - before, F.col("_i0"))
    hi = F.least(F.col(at) + after, F.col("_i0") + F.size("_v"))
    return rows.select(*peaks.columns, lo.alias("_lo"), F.slice(
        "_v", (lo - F.col("_i0") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).alias("_w"))


def snap(peaks: DataFrame, rectified: DataFrame, keys: list[str], reach: int, size: int = BLOCK) -> DataFrame:
    """Move each peak to the first maximum of the rectified trace within ``reach``; duplicates merge."""
    rows = windows_at(rectified, peaks.select(*keys, "i"), keys, reach, reach + 1, size)
    return rows.select(*keys, (F.col("_lo") + A.argmax_first("_w")).cast("long").alias("i")).distinct()


def detect(trace: DataFrame, keys: list[str], fs: float, highpass_hz: float, threshold_mad: float,
           refractory_ms: float, smoothing_ms: float, baseline_samples: int | None = None, size: int = PK.SIZE) -> dict[str, DataFrame]:
    """One detection per unit discharge: (keys, i) peaks and thresholds; packed, filtered and envelope are block rows.

    Samples are exchanged once, when they are packed.
    """
    width = smooth_width(smoothing_ms, fs)
    packed = materialize(PK.pack(trace, keys, size))
    filtered = materialize(PK.zero_phase_blocks(packed, keys, "highpass", highpass_hz, None, fs))
    env = materialize(PK.envelope_blocks(filtered, keys, width))
    thr = materialize(block_threshold(env, keys, threshold_mad, baseline_samples))
    marks = PK.marks_of(env, thr, keys).withColumnsRenamed({"kind": "_k", "falls": "_falls"})
    tops = thinned(maxima_of(marks, keys), keys, max(1, int(round(refractory_ms * 1e-3 * fs))))
    snapped = PK.at_peaks(filtered, tops, keys, width, width + 1, lambda w, lo, i: lo + int(np.abs(w).argmax()), T.LongType(), size)
    peaks = snapped.select(*keys, F.col("got").alias("i")).distinct()
    return {"peaks": peaks, "thresholds": thr, "packed": packed, "filtered": filtered, "envelope": env}


def block_threshold(env: DataFrame, keys: list[str], k: float, baseline_samples: int | None = None) -> DataFrame:
    """``mad_threshold`` of block rows."""
    return PK.block_quantiles(env, keys, {"_m": 0.5}, baseline_samples).select(
        *keys, (F.col("_m") / 0.6745).alias("sigma"), (F.col("_m") / 0.6745 * k).alias("threshold"))


def cut_blocks(measured: DataFrame, peaks: DataFrame, keys: list[str], half: int, base_half: int | None = None, out: str = "x",
               size: int = PK.SIZE) -> DataFrame:
    """``extract_waveforms`` from block rows: (keys, i, x)."""
    base = half if base_half is None else base_half
    h = max(half, base)

    def wave(w: np.ndarray, lo: int, i: int) -> np.ndarray | None:
        return w[h - half: h + half] - w[h - base: h + base].mean() if len(w) == 2 * h + 1 else None

    return PK.at_peaks(measured, peaks, keys, h, h + 1, wave, PK.ARRAY, size).withColumnRenamed("got", out)


# --- waveforms ----------------------------------------------------------------------------------

def extract_waveforms(measured: DataFrame, peaks: DataFrame, keys: list[str], half: int, base_half: int | None = None,
                      out: str = "x", at: str = "i") -> DataFrame:
    """Cut [p-half, p+half) minus the mean of a usually wider window; edge peaks are dropped.

    A peak needs ``p - h >= 0`` and ``p + h < n`` for the wider half window ``h``.
    """
    base = half if base_half is None else base_half
    h = max(half, base)
    rows = windows_at(measured, peaks, keys, h, h + 1, at=at).where(F.size("_w") == 2 * h + 1)
    level = A.mean(F.slice("_w", h - base + 1, 2 * base))
    cut = F.slice("_w", h - half + 1, 2 * half)
    wave = A.let(level, lambda m: F.transform(cut, lambda v: v - m))
    return rows.withColumn(out, wave).drop("_w", "_lo")


def reaverage(measured: DataFrame, spikes: DataFrame, keys: list[str], fs: float, half_ms: float,
              label: str = "label", t: str = "t") -> DataFrame:
    """Template per type from the trace at given spike times (sample = t*fs, half to even)."""
    half = int(round(half_ms * 1e-3 * fs))
    at = spikes.withColumn("i", F.rint(F.col(t) * fs).cast("long"))
    return templates(extract_waveforms(measured, at, keys, half, half), keys, label)


def wide_recut(measured: DataFrame, spikes: DataFrame, keys: list[str], half: int, base_half: int) -> DataFrame:
    """Re-cut a wider waveform for spikes already clustered; it must not lose any of them."""
    if half > base_half:
        raise ValueError("the template window must not exceed the baseline window used for clustering")
    out = extract_waveforms(measured, spikes, keys, half, base_half)
    if out.count() != spikes.count():
        raise ValueError("re-cutting dropped edge spikes; rows would no longer align")
    return out


def check_runs(waves: DataFrame, keys: list[str], fs: str = "fs", x: str = "x") -> DataFrame:
    """Per-pool consistency: pooled runs must share one sampling rate and one waveform length."""
    agg = [F.countDistinct(fs).alias("n_rates"), F.countDistinct(F.size(x)).alias("n_lengths"),
           F.count(F.lit(1)).alias("n_spikes")]
    return waves.groupBy(*keys).agg(*agg) if keys else waves.agg(*agg)


# --- per-waveform spectra -----------------------------------------------------------------------

def hf_power(waves: DataFrame, fs: float, cutoff: float = 500.0, x: str = "x", out: str = "hf_power") -> DataFrame:
    """Squared zero-phase high-pass of each waveform."""
    @F.pandas_udf("array<double>")
    def power(col: pd.Series) -> pd.Series:
        return col.map(lambda a: zero_phase(a, "highpass", cutoff, None, fs) ** 2)

    return waves.withColumn(out, power(x))


def center_select(waves: DataFrame, fs: float, n_trials: str = "n", cutoff: float = 500.0, tol_ms: float = 1.0,
                  min_trials: int = 10, x: str = "x", t_ms: str = "t_ms") -> DataFrame:
    """Keep templates whose high-frequency power peaks near t=0 and that average enough trials."""
    rows = hf_power(waves, fs, cutoff, x).withColumn("_p", A.argmax_first("hf_power"))
    return (rows.withColumn("peak_t_ms", F.col(t_ms)[F.col("_p")])
            .withColumn("centered", F.abs("peak_t_ms") <= tol_ms)
            .withColumn("enough_trials", F.col(n_trials) >= min_trials)
            .withColumn("survived", F.col("centered") & F.col("enough_trials")).drop("_p"))


def scalogram(waves: DataFrame, keys: list[str], fs: float, fmin: float = 50.0, fmax: float = 5000.0,
              n_freqs: int = 64, x: str = "x") -> DataFrame:
    """(keys, freq_hz, p, power): time-frequency power, one row per frequency and sample."""
    @F.pandas_udf("array<struct<freq_hz:double,power:array<double>>>")
    def transform(col: pd.Series) -> pd.Series:
        def one(a):
            f, p = morlet_power(np.asarray(a, dtype=float), fs, fmin, fmax, n_freqs)
            return [{"freq_hz": float(u), "power": row} for u, row in zip(f, p)]
        return col.map(one)

    bands = waves.select(*keys, F.explode(transform(x)).alias("_b"))
    return bands.select(*keys, "_b.freq_hz", F.posexplode("_b.power").alias("p", "power"))
