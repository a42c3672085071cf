"""Range order statistics, latency sweeps and the text writer against plain loops."""

import tempfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dischargelab.functions.ranges import RangeSelect, rate_departure
from dischargelab.operators import linkage as L
from dischargelab.sources import traces as SRC


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.data())
def test_range_select(values, data):
    v = np.array(values, dtype=float)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(v)), min_size=4, max_size=4)))
    both = np.sort(np.concatenate([v[cuts[0]:cuts[1]], v[cuts[2]:cuts[3]]]))
    ks = np.arange(len(both))
    ranges = [(np.full(len(ks), a), np.full(len(ks), b)) for a, b in ((cuts[0], cuts[1]), (cuts[2], cuts[3]))]
    assert RangeSelect(v).kth(ranges, ks).tolist() == both.tolist()


def plain_departure(train, t, member, window):
    near = list(train)
    if member:
        near.remove(t)
    near = np.array([x for x in near if abs(x - t) <= window])
    if len(near) < 2:
        return 0.0
    isi, mid = np.abs(near - t).min(), np.median(np.diff(near))
    return abs((1 / isi if isi > 0 else 0.0) - (1 / mid if mid > 0 else 0.0))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40), st.lists(st.integers(0, 60), max_size=10), st.integers(1, 30))
def test_rate_departure(train, others, window):
    train = np.sort(np.array(train, dtype=float)) / 8
    ts = np.concatenate([train, np.array(others, dtype=float) / 8])
    member = np.arange(len(ts)) < len(train)
    got = rate_departure(train, ts, member, window / 8)
    assert np.allclose(got, [plain_departure(train, t, m, window / 8) for t, m in zip(ts, member)], rtol=1e-12, atol=0)


def plain_latency(pdf, reach):
    rows = {}
    for k, run in pdf.groupby("k"):
        for i in run["label"].unique():
            for j in run["label"].unique():
                if i == j:
                    continue
                tj, hit = np.sort(run.loc[run.label == j, "t"].to_numpy()), []
                for t in run.loc[run.label == i, "t"]:
                    back, ahead = tj[tj < t], tj[tj >= t]
                    b, a = t - back[-1] if len(back) else np.inf, ahead[0] - t if len(ahead) else np.inf
                    if min(a, b) <= reach:
                        hit.append(a if a < b else -b)
                rows[k, i, j] = ((run.label == i).sum(), len(hit), *((np.mean(hit) * 1000, np.std(hit) * 1000, np.median(hit) * 1000) if hit else [np.nan] * 3))
    return rows


@pytest.mark.parametrize("bound", [5, 100000])
def test_pair_latency(spark, bound):
    rng = np.random.default_rng(4)
    n = 500
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 4, n)), "t": 1e9 + rng.integers(0, 900, n) / 8,
                        "label": rng.integers(0, 5, n), "spike_id": rng.permutation(n)})
    pdf.loc[:60, ["k", "t"]] = [0, 1e9 + 7]  # one instant of one run holds many
    spark.conf.set("dischargelab.maxGroupRows", str(bound))
    try:
        got = L.pair_latency(spark.createDataFrame(pdf), ["k"], 0.25).toPandas()
    finally:
        spark.conf.unset("dischargelab.maxGroupRows")
    want = plain_latency(pdf, 0.25)
    assert len(got) == len(want)
    for r in got.itertuples():
        mine = (r.n_i, r.n_matched, r.latency_mean_ms, r.latency_std_ms, r.latency_median_ms)
        assert np.allclose(np.array(mine, dtype=float), want[r.k, r.type_i, r.type_j], rtol=1e-7, atol=1e-6, equal_nan=True)
    assert L.pair_latency(spark.createDataFrame(pdf).where("k < 0"), ["k"], 0.25).count() == 0


def test_text_writer_keeps_other_runs_and_ids(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    make = lambda run, values: spark.createDataFrame([(run, i, float(v)) for i, v in enumerate(values)], "run_id string, i long, v double")
    SRC.write_text_trace(make("001", [1, 2, 3]), 100.0, d)
    SRC.write_text_trace(make("a/b", [4, 5]), 200.0, d)
    SRC.write_text_trace(make("001", [7, 8]), 300.0, d)
    rows = [tuple(r) for r in SRC.read_written_trace(spark, d).orderBy("run_id", "i").collect()]
    assert rows == [("001", 0, 7.0), ("001", 1, 8.0), ("a/b", 0, 4.0), ("a/b", 1, 5.0)]
    assert {r["file"]: r["fs"] for r in SRC.read_header(spark, f"{d}/Header").collect()} == {"001.txt": 300.0, "a/b.txt": 200.0}


def test_latencies_of_a_run_with_one_type(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, 1), ("a", 0, 2.0, 2)], "run_id string, label int, t double, spike_id long")
    assert L.nearest_latencies(rows, ["run_id"], 0.5).count() == 0
