"""Packed traces against whole-run filters and the row-wise operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dischargelab.functions.filters import zero_phase
from dischargelab.operators import packed as PK
from dischargelab.operators import signal as G

RUN = ["run_id"]
FILTERS = [("highpass", 100.0, None), ("highpass", 0.5, None), ("bandpass", 20.0, 300.0), ("bandpass", 1.0, 5000.0)]


@pytest.fixture(scope="module")
def runs():
    rng = np.random.default_rng(2)
    out = {"a": np.cumsum(rng.normal(size=5000)), "b": rng.normal(size=700) * 9 + 40, "c": np.round(rng.normal(size=1024) * 3)}
    out["c"][300:330] = 9.0  # a flat top across blocks
    return out


@pytest.fixture(scope="module")
def trace(spark, runs):
    pdf = pd.concat([pd.DataFrame({"run_id": k, "i": np.arange(len(v)), "v": v}) for k, v in runs.items()])
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(5).cache()


def series(df):
    pdf = df.toPandas().sort_values(["run_id", "i"])
    return {k: g["v"].to_numpy() for k, g in pdf.groupby("run_id")}


@pytest.mark.parametrize("size", [64, 301, 100_000])
def test_pack_keeps_samples_and_bounds_blocks(trace, runs, size):
    packed = PK.pack(trace, RUN, size)
    got = series(PK.unpack(packed, RUN))
    assert all((got[k] == v).all() for k, v in runs.items())
    assert packed.agg(F.max(F.size("v"))).first()[0] < 2 * size


@pytest.mark.parametrize("kind,low,high", FILTERS)
def test_filters_do_not_depend_on_blocks(trace, runs, monkeypatch, kind, low, high):
    monkeypatch.setattr(PK, "SPAN", 7)  # several spans per run
    for size in (64, 1000):
        packed = PK.pack(trace, RUN, size)
        got = series(PK.unpack(PK.zero_phase_blocks(packed, RUN, kind, low, high, 10_000.0), RUN))
        for k, v in runs.items():
            assert np.abs(got[k] - zero_phase(v, kind, low, high, 10_000.0)).max() < 1e-8 * np.abs(v).max()


def test_too_short_a_recording_is_an_error(spark):
    short = spark.createDataFrame([("x", i, 1.0) for i in range(15)], "run_id string, i long, v double")
    with pytest.raises(Exception, match="more than 15 samples"):
        G.highpass(short, RUN, 1000.0, 100.0).collect()


def test_quantiles_of_any_doubles(spark, trace, runs):
    odd = {"n": np.array([-1e300, -2.5, -2.5, -1e-310, 0.0, -0.0, 1e-310, 7.0, 1e300]), "one": np.array([3.25]), "two": np.array([-1.0, 4.0])}
    more = spark.createDataFrame(pd.concat([pd.DataFrame({"run_id": k, "i": np.arange(len(v)), "v": v}) for k, v in odd.items()]))
    packed = PK.pack(trace.unionByName(more), RUN, 50)
    qs = {"q0": 0.0, "q1": 0.3, "q2": 0.5, "q3": 1.0}
    got = {r["run_id"]: [r[c] for c in qs] for r in PK.block_quantiles(packed, RUN, qs).collect()}
    for k, v in {**runs, **odd}.items():
        assert np.allclose(got[k], np.quantile(v, list(qs.values())), rtol=1e-12, atol=0), k
    lead = {r["run_id"]: r["m"] for r in PK.block_quantiles(packed, RUN, {"m": 0.5}, first=130).collect()}
    assert all(lead[k] == np.median(v[:130]) for k, v in runs.items())


def test_detection_equals_the_row_operators(trace):
    args = dict(keys=RUN, fs=1000.0, highpass_hz=30.0, threshold_mad=0.8, refractory_ms=9.0, smoothing_ms=6.0)
    found = {size: G.detect(trace, size=size, **args) for size in (64, 4096)}
    filtered = G.highpass(trace, RUN, 1000.0, 30.0).cache()
    rect = G.rectify(filtered)
    env = G.envelope(rect, RUN, 6).cache()
    thr = G.mad_threshold(env, RUN, 0.8)
    want = G.snap(G.envelope_peaks(env, thr, RUN, 9), rect, RUN, 6)
    peaks = {tuple(r) for r in want.select("run_id", "i").collect()}
    assert len(peaks) > 50
    cut = {(r["run_id"], r["i"]): r["x"] for r in G.extract_waveforms(filtered, want, RUN, 8, 12).collect()}
    for size, f in found.items():
        assert {tuple(r) for r in f["peaks"].select("run_id", "i").collect()} == peaks
        got = {(r["run_id"], r["i"]): r["x"] for r in G.cut_blocks(f["filtered"], f["peaks"], RUN, 8, 12, size=size).collect()}
        assert got.keys() == cut.keys() and all(np.allclose(got[k], cut[k], atol=1e-9) for k in cut)


def test_flat_tops_across_blocks_count_once(spark):
    v = np.zeros(200)
    v[60:131] = 5.0
    v[150] = 7.0
    v[190:] = 9.0  # never falls
    trace = spark.createDataFrame(pd.DataFrame({"run_id": "x", "i": np.arange(200), "v": v}))
    thr = spark.createDataFrame([("x", 1.0)], "run_id string, threshold double")
    marks = PK.marks_of(PK.pack(trace, RUN, 16), thr, RUN).withColumnsRenamed({"kind": "_k", "falls": "_falls"})
    assert sorted((r["i"], r["v"]) for r in G.maxima_of(marks, RUN).collect()) == [(95, 5.0), (150, 7.0)]
