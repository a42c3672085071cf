import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dischargelab.functions.filters import zero_phase
from dischargelab.operators import embedding as EM
from dischargelab.operators import fits as FT
from dischargelab.operators import gap as GP
from dischargelab.operators import linkage as L
from dischargelab.operators import signal as G
from dischargelab.operators import simulate as SI
from dischargelab.params import SIMULATED_FULL
from dischargelab.plans import pipelines as P
from dischargelab.session import materialize
from dischargelab.sources import traces as SRC

FS = 4000.0


def library(spark):
    t = (np.arange(40) - 20) / 4.0
    shapes = [np.exp(-t ** 2 / 2) * 100, -np.exp(-t ** 2 / 6) * 80, np.sin(t) * np.exp(-t ** 2 / 8) * 160]
    return spark.createDataFrame(pd.DataFrame({"entry": [0, 1, 2], "x": [s.tolist() for s in shapes]}))


def test_blocked_filter_equals_whole(spark):
    x = np.random.default_rng(0).normal(size=9000).cumsum()
    df = spark.createDataFrame(pd.DataFrame({"run_id": "a", "i": np.arange(9000), "v": x}))
    for fn, args in ((G.highpass, (100.0,)), (G.bandpass, (20.0, 1500.0))):
        got = fn(df, ["run_id"], FS, *args, size=1000).orderBy("i").toPandas()
        ref = zero_phase(x, "highpass" if len(args) == 1 else "bandpass", args[0], args[1] if len(args) > 1 else None, FS)
        assert len(got) == 9000 and np.abs(got["v"].to_numpy() - ref).max() < 1e-9 * np.abs(ref).max()


def test_peaks_plateaus_and_edges(spark):
    v = [3, 1, 2, 2, 2, 1, 5, 5, 6, 0, 4, 4]  # the first and the last rise are not peaks
    df = spark.createDataFrame(pd.DataFrame({"run_id": "a", "i": range(12), "v": np.array(v, dtype=float)}))
    for size in (2, 3, 4096):
        assert sorted(r["i"] for r in G.local_maxima(df, ["run_id"], size).collect()) == [3, 8]


def test_envelope_matches_same_convolution(spark):
    x = np.random.default_rng(0).random(50)
    df = spark.createDataFrame(pd.DataFrame({"run_id": "a", "i": range(50), "v": x}))
    for w in (1, 4, 5):
        got = G.envelope(df, ["run_id"], w, 7).orderBy("i").toPandas()["v"]
        assert np.allclose(got, np.convolve(x, np.ones(w) / w, mode="same"))


def test_extract_edges(spark):
    df = spark.createDataFrame(pd.DataFrame({"run_id": "a", "i": range(30), "v": np.arange(30.0)}))
    peaks = spark.createDataFrame([("a", i) for i in (3, 4, 15, 25, 26)], "run_id string, i long")
    got = G.extract_waveforms(df, peaks, ["run_id"], 2, 4).orderBy("i").collect()
    assert [r["i"] for r in got] == [4, 15, 25] and got[1]["x"] == [-1.5, -0.5, 0.5, 1.5]


def test_empty_peaks(spark):
    df = spark.createDataFrame(pd.DataFrame({"run_id": "a", "i": range(30), "v": np.arange(30.0)}))
    none = spark.createDataFrame([], "run_id string, i long")
    assert G.extract_waveforms(df, none, ["run_id"], 2, 4).count() == 0


def test_generators(spark):
    units = spark.createDataFrame([("a", 1, 8.0), ("a", 2, 40.0)], "run string, u int, rate_hz double")
    tr = SI.gamma_train(units, ["run", "u"], 200.0, 10.0, 1).toPandas()
    for u, rate in ((1, 8.0), (2, 40.0)):
        t = np.sort(tr.loc[tr.u == u, "t"])
        isi = np.diff(t)
        assert abs(len(t) / 200.0 - rate) < 0.1 * rate and abs(isi.std() / isi.mean() - 10 ** -0.5) < 0.04
    noise = SI.colored_noise(spark, {"r": 150_000}, 1.0, 3).orderBy("i").toPandas()["v"].to_numpy()
    assert len(noise) == 150_000 and abs(noise.std() - 1) < 1e-9
    f = np.fft.rfftfreq(len(noise))
    p = np.abs(np.fft.rfft(noise)) ** 2
    edges = np.geomspace(2e-3, 0.3, 12)
    band = [p[(f >= a) & (f < b)].mean() for a, b in zip(edges[:-1], edges[1:])]
    slope = np.polyfit(np.log(np.sqrt(edges[:-1] * edges[1:])), np.log(band), 1)[0]
    assert -1.15 < slope < -0.85


def test_mixture_likelihood_rises(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.5, (150, 2)) for m in ((0, 0), (4, 0), (0, 4))])
    df = materialize(spark.createDataFrame(pd.DataFrame({"g": 0, "spike_id": range(450), "x": x.tolist()})).withColumn("g", F.col("g").cast("int")))
    for dof in (None, 4.0):
        fit = FT.mixture(df, "spike_id", [3], 1, dof)[0, 3]
        ll = fit.extra["ll"]
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(ll, ll[1:])) and np.allclose(sorted(fit.weights), [1 / 3] * 3, atol=0.03)
    lab = FT.assign(df, {0: FT.kmeans(df, "spike_id", [3], 1)[0, 3]}).orderBy("spike_id").toPandas()["label"].to_numpy()
    assert all(len(set(lab[k:k + 150])) == 1 for k in (0, 150, 300)) and len(set(lab)) == 3


def test_gap_prefers_truth(spark):
    rng = np.random.default_rng(0)
    one = rng.normal(0, 1, (160, 6))
    two = np.concatenate([rng.normal(-4, 1, (80, 6)), rng.normal(4, 1, (80, 6))])
    pdf = pd.DataFrame({"label": [0] * 160 + [1] * 160, "spike_id": range(320), "x": np.concatenate([one, two]).tolist()})
    got = {r["members"][0]: r for r in GP.gap_statistics(spark.createDataFrame(pdf), [(0,), (1,)], n_refs=15)}
    assert got[0]["gap1"] >= got[0]["gap2"] and got[1]["gap2"] > got[1]["gap1"] + got[1]["s2"]


def test_large_embedding_runs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (40, 5)) for c in (-3, 3)])
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "spike_id": range(80), "x": x.tolist()})).withColumn("g", F.col("g").cast("int"))
    y = np.stack(EM.embed(df, perplexity=8, n_iter=12, exact_rows=10).orderBy("spike_id").toPandas()["y"])
    assert y.shape == (80, 2) and np.isfinite(y).all()
    assert (y[:40, 0].mean() - y[40:, 0].mean()) ** 2 > y[:40, 0].var() + y[40:, 0].var()


def test_large_embedding_takes_one_job_per_iteration(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 4))
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "spike_id": range(60), "x": x.tolist()})).withColumn("g", F.col("g").cast("int"))
    jobs = []
    for n_iter in (1, 7):
        spark.sparkContext.setJobGroup(f"layout-{n_iter}", "")
        EM.embed_large(df, 60, 2, 8.0, n_iter).count()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"layout-{n_iter}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 6 + 2  # AQE may run a setup stage more or less


def test_layout_of_few_bytes_is_shared_without_a_shuffle(spark):
    """An iteration is one stage, so it leaves no shuffle files, and the layout is that of blocks that exchange positions."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (60, 4)) for c in (-2, 2)])
    x[100:110] = x[0]  # equal rows
    ids = rng.permutation(120) * 7 - 50
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "spike_id": ids, "x": x.tolist()})).withColumn("g", F.col("g").cast("int"))
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup("layout-shared", "")
    got = EM.embed_large(df, 120, 2, 8.0, 9).orderBy("spike_id").toPandas()
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [len(tracker.getJobInfo(j).stageIds) for j in sorted(tracker.getJobIdsForGroup("layout-shared"))]
    assert stages[-10:-1] == [1] * 9
    want = EM.embed_exchanged(df, 120, 8.0, 9).orderBy("spike_id").toPandas()
    assert got["spike_id"].tolist() == sorted(ids.tolist())
    np.testing.assert_allclose(np.stack(got["y"]), np.stack(want["y"]), rtol=1e-6, atol=1e-12)


def test_blocks_move_as_all_points_together():
    """A step of a block, with what other blocks send, is that of all edges and the whole grid."""
    rng = np.random.default_rng(2)
    y, v, p = rng.normal(0, 3, (30, 2)), rng.normal(0, 1, (30, 2)), rng.random((30, 30))
    p = np.where((p + p.T > 1.2) & ~np.eye(30, dtype=bool), p + p.T, 0.0)
    grid = np.c_[rng.integers(1, 5, 20), rng.normal(0, 3, (20, 2))]
    z, half = 7.0, np.arange(12)
    own, other = np.nonzero(p[half])
    heard, place = np.unique(other, return_inverse=True)
    got_y, got_v = EM.moved(y[half], v[half], (half, own, place, p[own, other], {}), y[heard], grid, z, 12.0, 0.5, 3.0)
    q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
    pull = ((12.0 * p * q)[..., None] * (y[:, None] - y[None])).sum(1)
    far = y[:, None] - grid[None, :, 1:]
    push = (grid[:, 0, None] * far / (1 + (far ** 2).sum(2, keepdims=True)) ** 2).sum(1) / z
    want = 0.5 * v - 12.0 * (pull - push)
    np.testing.assert_allclose(got_v, want[half])
    np.testing.assert_allclose(got_y, (y + want)[half])


def test_planted_units_are_recovered(spark):
    built = SI.build_traces(spark, library(spark), [3], FS, 20.0, 30.0)
    trace = materialize(SRC.through_text(built["trace"]))
    truth = materialize(built["truth"].select("run_id", "t", F.col("entry").cast("long").alias("unit")))
    p = SIMULATED_FULL.having(fs=FS, measure_band=(20.0, 1800.0), noise_baseline_samples=4000, feature_method="pca", silhouette_max_n=6)
    s = P.sort_recordings(trace, p)
    r = P.score(s.spikes.select("run_id", "spike_id", "t", "label"), truth, ["run_id"], 0.003).first()
    # Side-lobe detections may form a type of their own, which matches nothing; the units' types are clean.
    pur = L.purity(L.match_truth(s.spikes.where("label >= 0"), truth, ["run_id"], 0.003), ["run_id"]).toPandas()
    assert r["n_true_recovered"] == 3
    assert (pur.groupby("est_match")["purity"].max() > 0.9).all()
    assert (pur["purity"] * pur["n_spikes"]).sum() / pur["n_spikes"].sum() > 0.85
    m = P.merge_effect(s, truth, 0.003, n_refs=10).first()
    assert m["merged"] <= m["post"] <= m["raw"] and m["K"] == m["actual"] == 3 and m["method"] == "kmeans"
    manifest = P.compare_manifest(s.spikes, truth, p, 0.003).toPandas()
    assert len(manifest) == m["post"] and manifest["n_spikes"].sum() == s.spikes.where("label >= 0").count()
    assert manifest.loc[manifest["matched_true_unit"] >= 0, "matched_true_unit"].nunique() == m["rec_post"] == 3
    assert P.type_summary(s).count() == r["n_types_est"]


def test_text_and_header_sources(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rng = np.random.default_rng(0)
    data = {n: rng.normal(size=500) for n in ("r1", "r2")}
    for n, v in data.items():
        np.savetxt(os.path.join(d, f"{n}.txt"), v, fmt="%.6f")
    with open(os.path.join(d, "Header"), "w") as fh:
        fh.write("Type\tSamples\tSmplFrq\tFile\nX\t500\t8000\tr1.txt\nX\t500\t9000\tr1.txt\nshort\tline\n")
    tr = SRC.read_text_traces(spark, f"{d}/*.txt")
    back = tr.orderBy("run_id", "i").toPandas()
    assert np.allclose(back.loc[back.run_id.str.endswith("/r2"), "v"], data["r2"], atol=1e-6)
    assert {r[0] for r in tr.select(SRC.run_name()).distinct().collect()} == {"r1", "r2"}
    runs = spark.createDataFrame([("r1.txt",), ("r2.txt",)], "file string")
    rates = {r["file"]: r["fs"] for r in SRC.with_sample_rate(runs, SRC.read_header(spark, f"{d}/Header")).collect()}
    assert rates == {"r1.txt": 8000.0, "r2.txt": 24000.0}
    assert SRC.slice_rows(tr, 100.0, 1.0, 2.0).groupBy("run_id").count().first()["count"] == 200
    with pytest.raises(ValueError):
        SRC.slice_rows(tr, 100.0, 60.0, 1.0)
    SRC.write_text_trace(tr, 100.0, f"{d}/out")
    again = SRC.read_written_trace(spark, f"{d}/out").orderBy("run_id", "i").toPandas()
    assert np.allclose(again["v"], back["v"]) and again["run_id"].tolist() == back["run_id"].tolist()
    joined, bounds = SRC.concatenate(tr.withColumn("s", F.lit(1)), ["s"])
    assert joined.agg(F.max("i")).first()[0] == 999 and bounds.orderBy("run_id").select("start").collect()[1][0] == 500


def test_sort_store(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("b", 1, 0.7)], "run_id string, label int, t double")
    SRC.write_sort(df, f"{d}/s")
    assert SRC.load_sort(spark, f"{d}/s", run_id="a", label=1).count() == 1
