"""The given tables seen as spikes, waveforms and traces, in Spark and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dischargelab.operators.ordered import row_index
from dischargelab.operators.trains import relabel_dense

FS_WAVE = 24000.0
FS_TRACE = 1000.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Reading microseconds off a TIMESTAMP_NTZ this way does not depend on the session time zone.
SECONDS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6D"


def spikes(spark: SparkSession, d: str) -> DataFrame:
    """Point process: one train set per user, one type per event type."""
    ev = table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), "event_type", F.expr(SECONDS).alias("t"),
        F.col("value").alias("amp"), F.col("event_id").alias("spike_id"))
    return relabel_dense(ev, [], "event_type", "label").drop("event_type")


SPK = """spk AS (
  SELECT user_id AS run_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS label,
         CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t, value AS amp, event_id AS spike_id FROM events)"""


def truth(spark: SparkSession, d: str) -> DataFrame:
    """Known discharges: every event, displaced by its value, with a unit taken from its payload."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), (F.expr(SECONDS) + F.col("value") * 10.0).alias("t"),
        F.floor(F.get_json_object("props", "$.k").cast("long") / 10).cast("long").alias("unit"))


TRUTH = """tru AS (
  SELECT user_id AS run_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 + value * 10.0::DOUBLE AS t,
         CAST(props->>'$.k' AS BIGINT) // 10 AS unit FROM events)"""


def waveforms(spark: SparkSession, d: str, scale: bool = False) -> DataFrame:
    """Vectors as waveforms of 64 samples. All have unit norm, so ``scale`` spreads amplitudes."""
    x = F.col("embedding").cast("array<double>")
    if scale:
        x = F.transform(x, lambda v: v * (F.col("label") + 1).cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("spike_id"), "label", x.alias("x"))


WF = """wf AS (
  SELECT vec_id AS spike_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""
WFS = """wf AS (
  SELECT vec_id AS spike_id, CAST(label AS BIGINT) AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * CAST(label + 1 AS DOUBLE)) AS x FROM embeddings)"""
# One row per sample, 0-based position.
WFP = """wfp AS (SELECT spike_id, label, CAST(unnest(range(64)) AS BIGINT) AS p, unnest(x) AS v FROM wf)"""
TPL = """tpl AS (SELECT label, p, avg(v) AS v FROM wfp GROUP BY label, p)"""
TPLA = """tpa AS (SELECT label, list(v ORDER BY p) AS m FROM tpl GROUP BY label)"""


def trace(spark: SparkSession, d: str) -> DataFrame:
    """Sampled traces: one per event type, sample index in time order."""
    ev = table(spark, d, "events").select(
        F.col("event_type").alias("run_id"), "ts", "event_id", F.col("value").alias("v"))
    return row_index(ev, ["run_id"], ["ts", "event_id"], "i").select("run_id", "i", "v")


TRACE = """tr AS (
  SELECT event_type AS run_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS i,
         value AS v FROM events)"""
