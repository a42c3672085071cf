"""Cases that once went wrong: each failed before its fix."""

import os
import tempfile
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dischargelab import session
from dischargelab.operators import cluster as C
from dischargelab.operators import gap as GP
from dischargelab.operators import shapes as S
from dischargelab.operators import trains as TR
from dischargelab.params import BASE, CLINICAL, SIMULATED
from dischargelab.plans import pipelines as P
from dischargelab.sources import traces as SRC


def test_runs_keep_to_their_own_types(spark):
    rng = np.random.default_rng(0)
    a = pd.DataFrame({"run_id": "a", "label": 0, "t": np.sort(rng.uniform(0, 30, 60)), "x": [[v] for v in rng.normal(size=60)]})
    b = pd.DataFrame({"run_id": "b", "label": np.arange(60) % 3, "t": np.sort(rng.uniform(0, 30, 60)), "x": [[v] for v in rng.normal(size=60)]})
    df = spark.createDataFrame(pd.concat([a, b]).assign(spike_id=np.arange(120)))
    got = C.regularity_refine(df, ["run_id"], 5.0, 2.5, 3)
    assert {r["label"] for r in got.where("run_id = 'a'").select("label").collect()} == {0}


def test_equal_file_names_of_two_subjects(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for s, n in (("s1", 4), ("s2", 6)):
        os.makedirs(f"{d}/{s}")
        np.savetxt(f"{d}/{s}/EMGRUN__001.txt", np.arange(n, dtype=float))
    got = SRC.read_text_traces(spark, f"{d}/*/*.txt")
    sizes = {r["run_id"][-14:]: r["count"] for r in got.groupBy("run_id").count().collect()}
    assert sizes == {"s1/EMGRUN__001": 4, "s2/EMGRUN__001": 6}
    assert {r[0] for r in got.select(SRC.run_name()).collect()} == {"EMGRUN__001"}


def test_a_short_run_is_set_aside_and_the_others_go_on(spark):
    n = {"long": 40, "short": 1}
    cut = spark.createDataFrame([(r, i) for r, k in n.items() for i in range(k)], "run_id string, spike_id long")
    durations = spark.createDataFrame([("long", 10.0), ("short", 10.0), ("empty", 10.0)], "run_id string, duration_s double")
    seen = spark.createDataFrame([("long", 41), ("short", 1), ("empty", 0)], "run_id string, n_detected long")
    s = P.reject_small_pools(P.Sort(cut, BASE, durations=durations, detections=seen), False)
    assert {r["run_id"] for r in s.rejected.collect()} == {"short", "empty"} and s.spikes.count() == 40


def test_starting_count_follows_all_detections(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame(pd.DataFrame({"g": 0, "run_id": "a", "spike_id": np.arange(60), "x": [[0.0]] * 60, "features": list(rng.normal(size=(60, 2)))}))
    durations = spark.createDataFrame([("a", 3.0)], "run_id string, duration_s double")
    seen = spark.createDataFrame([("a", 61)], "run_id string, n_detected long")
    for detections, k in ((None, 2), (seen, 3)):
        _, ks, _ = P.cluster_pools(rows, BASE.having(silhouette_sweep=False), durations, False, detections)
        assert ks == {0: k}


def test_fence_of_zero_still_merges(spark, monkeypatch):
    called = []
    monkeypatch.setattr(P.TP, "l2_merge", lambda rows, *a, **k: called.append(k["fence_k"]) or rows)
    rows = spark.createDataFrame([("a", 0, 1, 0.1, 1.0), ("a", 1, 2, 0.2, 1.0)], "run_id string, label int, spike_id long, t double, amp double").withColumn("g", F.lit(0))
    p = BASE.having(min_isi_ms=0.0, link_max_latency_ms=0.0)
    P.clean_and_merge(rows, p, ["g"])
    assert not called
    P.clean_and_merge(rows, p.having(l2_merge_outlier_fence_k=0.0), ["g"])
    assert called == [0.0]


def test_no_more_cosines_than_samples(spark):
    df = spark.createDataFrame([([1.0, -2.0, 4.0],)], "x array<double>")
    assert np.allclose(S.dct_highpass(df, 8).first()["x"], 0, atol=1e-12)


def test_reference_points_of_large_ids(spark):
    df = spark.createDataFrame([(0, (9000 << 40) + i, [float(i)]) for i in range(4)], "label int, spike_id long, x array<double>")
    keys = [r["x"][0] for r in GP._ids(df, "spike_id").collect()]
    assert len(set(keys)) == 4 and max(keys) < 2**53


def test_equal_labels_of_two_pools_split_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(g, 0, g * 10 + i, float(i), [float(g), 1.0]) for g in range(2) for i in range(3)],
                                 "g int, label int, spike_id long, t double, x array<double>")
    seen = []
    monkeypatch.setattr(P.SP, "split_by_gap", lambda live: (seen.append({(r["g"], r["label"]) for r in live.collect()}), (live, []))[1])
    monkeypatch.setattr(P.TP, "l2_merge_stage", lambda rows, keys, fs: rows)
    got, _ = P.split_then_merge(SimpleNamespace(spikes=rows, params=BASE), ["g"], how="gap")
    assert seen == [{(0, 0), (1, 1)}]
    assert {(r["g"], r["label"]) for r in got.collect()} == {(0, 0), (1, 0)}


def test_rates_hold_every_spike_and_grid_point(spark):
    spikes = spark.createDataFrame([("a", 0, 3.0), ("a", 0, 90.5), ("a", 1, 50.0)], "run_id string, label int, t double")
    epochs = spark.createDataFrame([("a", 0.0, 100.0)], "run_id string, a double, b double")
    got = TR.gaussian_rate(spikes, epochs, ["run_id"], "label", 0.5, 2.0, block=16).toPandas().sort_values(["label", "g"])
    assert len(got) == 400
    grid = np.arange(200) * 0.5
    want = sum(np.exp(-0.5 * ((grid - t) / 2.0) ** 2) for t in (3.0, 90.5)) / (2.0 * np.sqrt(2 * np.pi))
    assert np.allclose(got[got.label == 0]["rate"], want, rtol=1e-12, atol=0)


def test_checkpoints_need_a_shared_folder_off_a_single_machine():
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def test_one_row_sides_are_asserted(spark):
    two = spark.createDataFrame([(1,), (2,)], "m int")
    with pytest.raises(ValueError):
        session.attach(two.withColumnRenamed("m", "v"), two, [])


def test_presets_state_their_own_silhouette_sample():
    assert BASE.silhouette_sample is None and SIMULATED.silhouette_sample == CLINICAL.silhouette_sample == 4000


def test_pools_merge_as_if_each_were_alone(spark):
    rng = np.random.default_rng(3)
    parts = []
    for g in range(2):
        centers = np.array([[0.0, 0], [0.3, 0], [9, 9], [9.2, 9]]) + g
        for label, c in enumerate(centers):
            parts += [(g, label, (g * 4 + label) * 100 + i, (c + rng.normal(size=2)).tolist()) for i in range(40)]
    rows = spark.createDataFrame(parts, "g int, label int, spike_id long, x array<double>")
    together, _ = P.gap_anchor_merge(rows, 10, ["g"])
    got = {r["spike_id"]: r["label"] for r in together.collect()}
    alone = {r["spike_id"]: r["label"] for g in range(2) for r in P.gap_anchor_merge(rows.where(F.col("g") == g), 10)[0].collect()}
    assert got == alone and set(got.values()) == {0, 1}


def test_merge_by_silhouette_and_unknown_test(spark):
    rng = np.random.default_rng(5)
    centers = np.array([[0.0, 0], [0.1, 0], [9, 9]])
    parts = [(label, label * 100 + i, (c + rng.normal(size=2)).tolist()) for label, c in enumerate(centers) for i in range(40)]
    rows = spark.createDataFrame(parts, "label int, spike_id long, x array<double>")
    merged, log = P.gap_anchor_merge(rows, test="silhouette")
    assert {(r["spike_id"] // 100, r["label"]) for r in merged.collect()} == {(0, 0), (1, 0), (2, 1)}
    assert [(r["anchor"], r["other"], r["one"], r["n_pool"]) for r in log] == [(0, 1, True, 80)]
    with pytest.raises(ValueError):
        P.gap_anchor_merge(rows, test="other")


def test_composites_are_named_in_the_manifest(spark):
    i = np.arange(64)
    a, b = np.exp(-((i - 22) / 3.0) ** 2), -1.5 * np.exp(-((i - 40) / 4.0) ** 2)
    waves = [a, b, a + b]
    rows = spark.createDataFrame([("r", n * 10 + k, n + k * 5.0, n, w.tolist()) for n, w in enumerate(waves) for k in range(4)],
                                 "run_id string, spike_id long, t double, label int, x array<double>")
    truth = spark.createDataFrame([("r", n + k * 5.0, n) for n in range(2) for k in range(4)], "run_id string, t double, unit long")
    got = P.compare_manifest(rows, truth, BASE, 0.003).orderBy("estimated_type").collect()
    assert [(r["n_spikes"], r["matched_true_unit"], r["purity"], r["is_superposition"]) for r in got] == [
        (4, 0, 1.0, False), (4, 1, 1.0, False), (4, -1, 0.0, True)]
    assert set(got[2]["superposition_of"].split("+")) == {"0", "1"} and got[2]["superposition_pair_residual"] < 0.001
    assert got[0]["superposition_of"] == "" and got[0]["n_muaps_in_trace"] == 2
