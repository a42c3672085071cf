"""Queries over whole sorts of the given tables seen as recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from dischargelab.operators import simulate as SI
from dischargelab.operators import templates as TP
from dischargelab.params import BASE, CLINICAL, JOINT, LIBRARY
from dischargelab.plans import pipelines as P
from dischargelab.plans.fixtures import FS_TRACE, trace, waveforms
from dischargelab.plans.registry import query
from dischargelab.session import materialize

# The tables hold a value per event, sampled here at 1 kHz: windows and cut-offs scale with it.
SLOW = dict(fs=FS_TRACE, highpass_hz=100.0, threshold_mad=1.2, measure_band=(20.0, 400.0), window_ms=10.0, baseline_window_ms=15.0,
            smoothing_ms=4.0, refractory_ms=6.0, min_isi_ms=20.0)


def recording(spark, d):
    return materialize(trace(spark, d))


@query("run_pipeline")
def run_pipeline(spark, d):
    p = BASE.having(**SLOW, feature_method="pca", l2_merge_outlier_fence_k=2.0)
    s = P.sort_recordings(recording(spark, d), p)
    return P.type_summary(s)


@query("sort_pool")
def sort_pool(spark, d):
    s = P.sort_recordings(recording(spark, d), JOINT.having(**{**SLOW, "threshold_mad": 1.0}, feature_method="wavelet"), joint=True)
    return s.spikes.select("run_id", "spike_id", "t", "amp", "label")


@query("post_process")
def post_process(spark, d):
    p = BASE.having(**SLOW, feature_method="pca", cluster_method="gmm", isi_weight=0.0, drop_superposition=True)
    s = P.sort_recordings(recording(spark, d), p)
    return s.spikes.select("run_id", "spike_id", "label")


@query("subject_summary")
def subject_summary(spark, d):
    return P.sort_subject(recording(spark, d), CLINICAL.having(**SLOW))["summary"]


@query("subject_library")
def subject_library(spark, d):
    meta = spark.range(1).select(F.lit("test0_normal").alias("subject"), F.lit("Normal").alias("category"), F.lit("TA").alias("muscle"), F.lit("Left").alias("side"))
    out = P.subject_library(recording(spark, d), LIBRARY.having(**{**SLOW, "threshold_mad": 1.0}, feature_method="pca"), meta)
    return out.drop("waveform")


@query("l2split")
def l2split(spark, d):
    s = P.sort_recordings(recording(spark, d), JOINT.having(**{**SLOW, "threshold_mad": 0.9}, feature_method="pca"), joint=True)
    out, _ = P.split_then_merge(s)
    return out.select("run_id", "spike_id", "label")


@query("simulate_and_score")
def simulate_and_score(spark, d):
    """Recordings built from the vectors' mean shapes, sorted and scored against their known units."""
    lib = TP.templates(waveforms(spark, d, True), []).select(
        F.col("label").alias("entry"), F.transform("m", lambda v, i: v * 100 * F.exp(-F.pow((i - 32) / 8.0, 2))).alias("x"))
    built = SI.build_traces(spark, lib, [3, 5], 4000.0, 20.0, 30.0)
    truth = built["truth"].select("run_id", "t", F.col("entry").cast("long").alias("unit"))
    return P.sweep_and_score(materialize(built["trace"]), materialize(truth), 4000.0, features=("pca",), methods=("kmeans",), post=("full",),
                             max_units=5, extra_k=2, measure_band=(20.0, 1800.0))
