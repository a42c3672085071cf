"""Synthetic recordings with known discharges.

Random numbers are keyed by (seed, unit, chunk) or (seed, run, block), so any task can regenerate
its part and results do not depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dischargelab.operators.ordered import running_sum
from dischargelab.operators.sampling import hash_sample
from dischargelab.session import attach

CHUNK = 1024
SLICE = 64  # chunks that are rows at once
NOISE_BLOCK = 1 << 16
NOISE_TAPS = 1 << 15


def _uniform(seed: int, *cols: Column) -> Column:
    h = F.xxhash64(F.lit(seed), *cols)
    return F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53)


def gamma_train(units: DataFrame, keys: list[str], duration_s: float, shape: float, seed: int, rate: str = "rate_hz",
                start_s: float = 0.0) -> DataFrame:
    """(keys, seq, t): gamma-renewal discharges of every unit until ``duration_s``, then shifted.

    Intervals are drawn in independent chunks, as many as a train could need with overwhelming
    probability (mean count plus 12 standard deviations), and a two-level running sum turns them
    into times, so one fast or long unit is not one task.
    """
    need = F.col(rate) * duration_s
    total = F.ceil(need + F.sqrt(need / shape) * 12 + 32)
    rows = units.select(*keys, rate, total.alias("_n")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / CHUNK).cast("int") - 1)))
    rows = rows.withColumn("_m", F.least(F.col("_n") - F.col("chunk") * CHUNK, F.lit(CHUNK)))  # the last chunk is cut to the need
    rows = rows.withColumn("_seed", F.xxhash64(F.lit(seed), *keys, "chunk"))

    schema = T.StructType([units.schema[k] for k in keys] + [T.StructField("seq", T.LongType()), T.StructField("_isi", T.DoubleType())])

    def draw(batches):
        """Intervals leave a task a few chunks at a time, however many chunks a batch names."""
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at:at + SLICE]
                size = part["_m"].to_numpy(np.int64)
                isi = [np.random.default_rng(abs(int(s))).gamma(shape, 1.0 / (hz * shape), m) for s, hz, m in zip(part["_seed"], part[rate], size)]
                out = part[keys].loc[part.index.repeat(size)].reset_index(drop=True)
                out["seq"] = np.concatenate([c * CHUNK + np.arange(m) for c, m in zip(part["chunk"].to_numpy(np.int64), size)])
                out["_isi"] = np.concatenate(isi)
                yield out

    isi = rows.mapInPandas(draw, schema)
    t = running_sum(isi, keys, ["seq"], F.col("_isi"), "t")
    return t.where(F.col("t") < duration_s).select(*keys, "seq", (F.col("t") + start_s).alias("t"))


def _white(seed: int, block: int) -> np.ndarray:
    return np.random.default_rng([seed, block]).standard_normal(NOISE_BLOCK)


def colored_noise(spark: SparkSession, runs: dict[str, int], beta: float, seed: int) -> DataFrame:
    """(run_id, i, v): unit-variance noise with power falling as 1/f^beta.

    White noise of any block can be regenerated from its number, and a long power-law filter shapes
    it, so blocks are independent of each other and no run is held whole. ``runs`` maps run id to
    its length in samples.
    """
    listing = spark.createDataFrame([(r, n, k) for k, (r, n) in enumerate(sorted(runs.items()))], "run_id string, n long, rn long")
    blocks = listing.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / NOISE_BLOCK) - 1)))
    taps = np.cumprod(np.concatenate([[1.0], (np.arange(1, NOISE_TAPS) - 1 + beta / 2) / np.arange(1, NOISE_TAPS)]))
    sd = float(np.sqrt((taps ** 2).sum()))

    def shape(batches):
        n_fft = 1 << int(NOISE_BLOCK + NOISE_TAPS).bit_length()
        response = np.fft.rfft(taps / sd, n_fft)
        for pdf in batches:
            for row in pdf.itertuples():
                base = seed * 1009 + int(row.rn)
                x = np.concatenate([_white(base, int(row.b)), _white(base, int(row.b) + 1)])[NOISE_BLOCK - NOISE_TAPS:]
                y = np.fft.irfft(np.fft.rfft(x, n_fft) * response, n_fft)[NOISE_TAPS:NOISE_TAPS + NOISE_BLOCK]
                i = np.arange(NOISE_BLOCK) + row.b * NOISE_BLOCK
                live = i < row.n
                yield pd.DataFrame({"run_id": row.run_id, "i": i[live], "v": y[live]})

    width = max(1, min(spark.sparkContext.defaultParallelism * 4, sum(-(-n // NOISE_BLOCK) for n in runs.values())))
    raw = blocks.repartition(width, "run_id", "b").mapInPandas(shape, "run_id string, i long, v double")
    sd_run = raw.groupBy("run_id").agg(F.stddev_pop("v").alias("_s"))
    return attach(raw, sd_run, ["run_id"]).select("run_id", "i", (F.col("v") / F.col("_s")).alias("v"))


def superpose(spikes: DataFrame, templates: DataFrame, keys: list[str], unit: list[str], fs: float, n_samples: int,
              x: str = "x") -> DataFrame:
    """(keys, i, v): sum of templates centered on their unit's discharges, cut at the recording's ends.

    Only samples some template touches are present. Each (spike, sample) contribution is summed
    map-side first, so dense stretches do not pile up in one task.
    """
    half = F.floor(F.size(x) / 2)
    rows = attach(spikes, templates.select(*unit, x), unit)
    first = F.rint(F.col("t") * fs).cast("long") - half
    pos = rows.select(*keys, first.alias("_f"), F.posexplode(x).alias("_p", "_v"))
    pos = pos.select(*keys, (F.col("_f") + F.col("_p")).alias("i"), "_v").where((F.col("i") >= 0) & (F.col("i") < n_samples))
    return pos.groupBy(*keys, "i").agg(F.sum("_v").alias("v"))


def build_traces(spark: SparkSession, library: DataFrame, counts: list[int], fs: float, duration_s: float, snr_db: float, seed: int = 42,
                 baseline_s: float = 1.0, shape: float = 10.0, beta: float = 1.0, rates: tuple[float, float] = (1.0, 10.0)) -> dict[str, DataFrame]:
    """Recordings with K units each: ``trace``, ``truth`` (discharges) and ``manifest`` (units).

    ``library`` is (entry, x). Units are drawn without replacement in hash order with seed + K, rates
    are uniform, the first ``baseline_s`` seconds stay quiet, noise is scaled to the signal's RMS.
    """
    parts = []
    for k in counts:
        chosen = hash_sample(library.select("entry"), [], "entry", k, seed + k)
        parts.append(chosen.select(F.lit(f"n{k}").alias("run_id"), F.lit(k).alias("n_muaps"), "entry"))
    units = parts[0]
    for p in parts[1:]:
        units = units.unionByName(p)
    u = _uniform(seed, F.col("run_id"), F.col("entry"))
    units = units.withColumn("rate_hz", u * (rates[1] - rates[0]) + rates[0])
    truth = gamma_train(units, ["run_id", "entry"], duration_s, shape, seed, start_s=baseline_s)
    n = int(round(baseline_s * fs)) + int(round(duration_s * fs))
    clean = superpose(truth, library, ["run_id"], ["entry"], fs, n)
    power = clean.groupBy("run_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v")) / n).alias("_rms"))
    noise = colored_noise(spark, {f"n{k}": n for k in counts}, beta, seed).withColumnRenamed("v", "_e")
    gain = F.when(F.col("_rms") > 0, F.col("_rms") / (10 ** (snr_db / 20.0))).otherwise(1.0)
    trace = attach(noise.join(clean.withColumnRenamed("v", "_c"), ["run_id", "i"], "left"), power, ["run_id"], "left").select(
        "run_id", "i", (F.coalesce("_c", F.lit(0.0)) + F.col("_e") * F.coalesce(gain, F.lit(1.0))).alias("v"))
    size = truth.groupBy("run_id", "entry").agg(F.count(F.lit(1)).alias("n_spikes"))
    manifest = units.join(size, ["run_id", "entry"], "left").select(
        "run_id", "n_muaps", "entry", F.round("rate_hz", 3).alias("assigned_firing_rate_hz"), F.coalesce("n_spikes", F.lit(0)).alias("n_spikes"))
    return {"trace": trace, "truth": truth, "manifest": manifest}
