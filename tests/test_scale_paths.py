"""The paths for oversized groups must give what the plain paths give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dischargelab.operators import cluster as C
from dischargelab.operators import fits as FT
from dischargelab.operators import gap as GP
from dischargelab.operators import linkage as L
from dischargelab.operators import ordered as O
from dischargelab.operators import tiles as TI
from dischargelab.operators import trains as TR
from dischargelab.operators.sampling import hash_sample
from dischargelab.session import materialize


def skewed(spark, n=1200, seed=0, step=1000):
    """Two thirds of the rows belong to one key."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.66, 0, rng.integers(1, 6, n)), "t": rng.integers(0, step, n) / 8.0,
                        "amp": rng.integers(-20, 20, n).astype(float), "spike_id": rng.permutation(n), "label": rng.integers(0, 4, n)})
    return spark.createDataFrame(pdf).repartition(7), pdf


def same(a, b, by):
    a, b = (x.toPandas().sort_values(by).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(b.columns)], check_dtype=False)


def test_index_sum_neighbours(spark):
    df, _ = skewed(spark)
    key, order = ["k"], ["t", "spike_id"]
    for fn in (lambda b: O.row_index(df, key, order, "i", b),
               lambda b: O.running_sum(df, key, order, F.col("label").cast("long"), "s", b),
               lambda b: O.islands(df, key, order, F.col("label") == 0, "g", b),
               lambda b: O.neighbours(df, key, order, {"p": F.col("t"), "p0": F.when(F.col("label") == 0, F.col("t"))},
                                      {"n": F.col("t"), "n3": F.when(F.col("label") == 3, F.col("t"))}, b)):
        same(fn(True), fn(False), ["spike_id"])


def test_quantiles(spark):
    df, pdf = skewed(spark)
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.99, "top": 1.0, "min": 0.0}
    got = O.quantiles(df, ["k"], "t", probs, bounded=False).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(got.loc[k, list(probs)].astype(float), np.quantile(g["t"], list(probs.values())))
    one = O.quantiles(df, [], "t", {"q": 0.37}, bounded=False).first()["q"]
    assert one == pytest.approx(np.quantile(pdf["t"], 0.37))


def test_rates_of_hot_units(spark, tight):
    df, pdf = skewed(spark)
    epochs = spark.createDataFrame([(k, 0.0, 130.0) for k in range(6)], "k long, a double, b double")
    widest, collect = [], TR.F.collect_list
    got = TR.gaussian_rate(df, epochs, ["k"], "label", 0.5, 2.0).toPandas()
    assert not got.duplicated(["k", "label", "g"]).any()
    parts, split = TR._parts(df.select("k", F.col("t").alias("_x")), ["k"])
    assert split and parts.groupBy("k", "_s").count().agg(F.max("count")).first()[0] <= 80
    assert parts.agg(F.sum("_w")).first()[0] == len(pdf)
    grid = np.arange(260) * 0.5
    for (k, label), rows in got.groupby(["k", "label"]):
        t = pdf[(pdf.k == k) & (pdf.label == label)]["t"].to_numpy()
        want = np.exp(-0.5 * ((grid - t[:, None]) / 2.0) ** 2).sum(axis=0) / (2.0 * np.sqrt(2 * np.pi))
        assert np.allclose(rows.sort_values("g")["rate"], want, rtol=1e-12, atol=0)


@pytest.mark.parametrize("t_min,step", [(0.5, 4000), (20.0, 400)])
def test_min_isi_paths(spark, tight, t_min, step):
    df, pdf = skewed(spark, step=step)
    got = TR.min_isi(df, ["k"], t_min).toPandas().set_index("spike_id")["keep"]
    for _, g in pdf.groupby("k"):
        g = g.assign(a=-g["amp"].abs()).sort_values(["a", "t", "spike_id"])
        kept = []
        for r in g.itertuples():
            ok = all(abs(r.t - u) >= t_min for u in kept)
            assert got[r.spike_id] == ok
            if ok:
                kept.append(r.t)


def test_min_isi_ramp_across_chunks(spark, tight):
    """A rising ramp decides from its far end; verdicts must travel through many chunks."""
    n = 240
    pdf = pd.DataFrame({"k": 0, "t": np.arange(n) * 0.9, "amp": np.arange(n, dtype=float) + 1, "spike_id": np.arange(n)})
    got = TR.min_isi(spark.createDataFrame(pdf), ["k"], 1.0).toPandas().sort_values("spike_id")
    assert got["keep"].tolist() == [(n - 1 - i) % 2 == 0 for i in range(n)]


def test_pair_latency_and_match(spark, tight):
    df, pdf = skewed(spark, 400)
    got = L.pair_latency(df, ["k"], 2.0).toPandas().set_index(["k", "type_i", "type_j"])
    for k, g in pdf.groupby("k"):
        for i in g["label"].unique():
            for j in g["label"].unique():
                if i == j:
                    continue
                ti, tj = np.sort(g.loc[g.label == i, "t"]), np.sort(g.loc[g.label == j, "t"])
                d = tj[None, :] - ti[:, None]
                best = np.take_along_axis(d, np.abs(d).argmin(1)[:, None], 1)[:, 0]
                m = best[np.abs(best) <= 2.0]
                row = got.loc[(k, i, j)]
                assert row["n_i"] == len(ti) and row["n_matched"] == len(m)
                if len(m):
                    assert row["latency_mean_ms"] == pytest.approx(m.mean() * 1000)
                    assert row["latency_median_ms"] == pytest.approx(np.median(m) * 1000)
    truth = df.select("k", (F.col("t") + 0.0625).alias("t"), F.col("label").alias("unit"))
    hit = L.match_truth(df, truth, ["k"], 0.25).toPandas()
    assert len(hit) == len(pdf) and (hit["matched_unit"] >= 0).all()


def test_match_ties_and_tolerance(spark):
    est = spark.createDataFrame([(0, 1.0, 1), (0, 5.0, 2), (0, 9.0, 3)], "k int, t double, spike_id long")
    truth = spark.createDataFrame([(0, 0.5, 7), (0, 1.5, 8), (0, 5.5, 9), (0, 9.51, 4)], "k int, t double, unit int")
    got = {r["spike_id"]: r["matched_unit"] for r in L.match_truth(est, truth, ["k"], 0.5).collect()}
    assert got == {1: 7, 2: 9, 3: -1}


def test_components_paths(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(r), int(a), int(b)) for r in range(3) for a, b in rng.integers(0, 30, (20, 2)) if a != b]
    pairs += [(9, i, i + 1) for i in range(40)]
    df = spark.createDataFrame(pairs, "run int, type_a int, type_b int")
    same(L.components(df, ["run"]), L.components(df, ["run"], small=0), ["run", "type"])


def test_tiles_any_block(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    lab = rng.integers(-1, 3, (120, 2))
    df = spark.createDataFrame(pd.DataFrame({"g": [0] * 80 + [1] * 40, "spike_id": range(120), "x": list(x), "labels": list(lab)}))
    df = df.withColumn("g", F.col("g").cast("int"))
    got = {(r["g"], r["labeling"]): r["silhouette"] for r in TI.silhouette(df, "spike_id", 2, block=16).collect()}
    for g, idx in ((0, np.arange(80)), (1, np.arange(80, 120))):
        for s in (0, 1):
            keep = idx[lab[idx, s] >= 0]
            d = np.sqrt(((x[keep][:, None] - x[keep][None]) ** 2).sum(2))
            ll, val = lab[keep, s], []
            for i in range(len(keep)):
                own = ll == ll[i]
                a = d[i][own].sum() / (own.sum() - 1) if own.sum() > 1 else None
                b = min(d[i][ll == c].mean() for c in set(ll) if c != ll[i])
                val.append(0.0 if a is None else (b - a) / max(a, b))
            assert got[g, s] == pytest.approx(np.mean(val))
    same(TI.nearest(df, "spike_id", 5, block=16), TI.nearest(df, "spike_id", 5, block=1000), ["sid", "rank"])


def test_tiles_of_copies(spark, monkeypatch):
    """Copies are one row of a tile; ties between them go to the smaller ids, as if all pairs were compared."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (300, 2)).astype(float) + 1e6
    lab = (x[:, 0] > 1e6 + 1).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "spike_id": rng.permutation(300), "x": list(x), "labels": [[v] for v in lab]}))
    df = materialize(df.withColumn("g", F.col("g").cast("int")))
    sent = []
    tiles = TI.tiles
    monkeypatch.setattr(TI, "tiles", lambda rows, *a: (sent.append(rows.count()), tiles(rows, *a))[1])
    pdf = df.toPandas()
    pts, ids = np.stack(pdf["x"]), pdf["spike_id"].to_numpy()
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    for k in (4, 40):
        got = TI.nearest(df, "spike_id", k, block=4).orderBy("sid", "rank").toPandas()
        for i in range(300):
            near = [j for j in np.lexsort((ids, d[i])) if j != i][:k]
            mine = got[got["sid"] == ids[i]]
            assert mine["other"].tolist() == ids[near].tolist() and np.allclose(mine["dist"], d[i, near])
    own = np.stack(pdf["labels"])[:, 0]
    want = []
    for i in range(300):
        a, b = d[i][own == own[i]].sum() / ((own == own[i]).sum() - 1), d[i][own != own[i]].mean()
        want.append((b - a) / max(a, b))
    row = TI.silhouette(df, "spike_id", block=4).first()
    assert row["n"] == 300 and row["silhouette"] == pytest.approx(np.mean(want))
    assert sent == [16, 16, 16]


def test_distances_keep_digits():
    a = np.random.default_rng(0).normal(size=(50, 8)) + 1e3
    b = np.concatenate([a + 1e-7, a])
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert np.allclose(TI.distances(a, b), want, rtol=1e-8, atol=0) and (TI.distances(a, a).diagonal() == 0).all()


def test_hash_sample_ignores_partitioning(spark, tight):
    df, _ = skewed(spark)
    a = hash_sample(df, ["k"], "spike_id", 25, 7)
    same(a, hash_sample(df.repartition(3), ["k"], "spike_id", 25, 7), ["spike_id"])
    assert a.groupBy("k").count().agg(F.max("count")).first()[0] == 25


def test_relabel_and_big_types(spark, tight):
    df, pdf = skewed(spark)
    dense = TR.relabel_dense(df.withColumn("label", F.col("label") * 5 + 2), ["k"]).toPandas()
    assert dense.groupby("k")["label"].agg(lambda s: sorted(set(s)) == list(range(len(set(s))))).all()
    big = TR.keep_big_types(df, ["k"], 60).toPandas()
    small = pdf.groupby(["k", "label"])["t"].transform("size") < 60
    assert (big.set_index("spike_id")["label"] == -1).sum() == small.sum()


def test_regularity_any_density(spark, tight):
    df, _ = skewed(spark, 300)
    df = df.withColumn("x", F.array(F.col("amp"), F.col("t") / 50))
    a = C.regularity_costs(df, ["k"], [0, 1, 2, 3], 0.3, 5.0)
    got = a.toPandas().sort_values(["spike_id", "c"])
    spark.conf.set("dischargelab.maxGroupRows", "100000")
    want = C.regularity_costs(df, ["k"], [0, 1, 2, 3], 0.3, 5.0).toPandas().sort_values(["spike_id", "c"])
    assert len(got) == 1200 and np.allclose(got["cost"], want["cost"])


@pytest.mark.parametrize("bound", [30, 100000])
def test_power_of_spikes(spark, monkeypatch, bound):
    """The same F and P as from a row per unit and grid point, which is not made."""
    df, _ = skewed(spark, 400)
    df = df.withColumn("t", F.when(F.col("spike_id") % 9 == 0, 50.0).otherwise(F.col("t")))
    ep = df.groupBy("k").agg(F.lit(0.0).alias("a"), F.lit(125.0).alias("b"))
    amp = df.where("label < 3").groupBy("k", "label").agg(F.when(F.col("label") != 1, F.avg("amp")).alias("amp"),
                                                          F.when(F.col("k") != 2, F.max("amp")).alias("ptp"))
    amp = amp.withColumn("amp", F.when(F.col("k") != 4, F.col("amp"))).withColumn("ptp", F.when(F.col("k") != 4, F.col("ptp")))
    want = TR.power_vs_rate(TR.gaussian_rate(df, ep, ["k"], "label", 1.0, 2.0, block=16), amp, ["k"], "label")
    want = want.toPandas().sort_values(["k", "g"], ignore_index=True)
    monkeypatch.setattr(TR, "gaussian_rate", None)
    spark.conf.set("dischargelab.maxGroupRows", str(bound))
    try:
        got = TR.power_of_spikes(df, ep, amp, ["k"], "label", 1.0, 2.0, block=16).toPandas().sort_values(["k", "g"], ignore_index=True)
    finally:
        spark.conf.unset("dischargelab.maxGroupRows")
    assert len(got) == len(want) and (got[["k", "g"]] == want[["k", "g"]]).all().all()
    assert np.allclose(got["f"], want["f"], atol=1e-12) and np.allclose(got["p"], want["p"], atol=1e-9, equal_nan=True)
    assert got["p"].isna().any()


def test_quantiles_without_a_sort(spark, tight, monkeypatch):
    """Large groups are bracketed by a sketch; only a rank outside its bracket needs the sort."""
    rng = np.random.default_rng(8)
    n = 30000
    pdf = pd.DataFrame({"k": rng.integers(0, 2, n), "v": np.where(rng.random(n) < 0.3, 1.0, rng.exponential(size=n))})
    probs = {"a": 0.0, "b": 0.5, "c": 0.9371, "d": 1.0}
    df = spark.createDataFrame(pdf)
    sort = O._range_sorted
    monkeypatch.setattr(O, "_range_sorted", None)
    got = {r["k"]: r for r in O.quantiles(df, ["k"], "v", probs, bounded=False).collect()}
    monkeypatch.setattr(O, "_range_sorted", sort)
    monkeypatch.setattr(O, "_bracketed", lambda *a: None)
    plain = {r["k"]: r for r in O.quantiles(df, ["k"], "v", probs, bounded=False).collect()}
    for k in (0, 1):
        want = np.quantile(pdf.loc[pdf["k"] == k, "v"], list(probs.values()))
        assert np.allclose([got[k][p] for p in probs], want, rtol=1e-12) and np.allclose([plain[k][p] for p in probs], want, rtol=1e-12)


def test_gamma_train_draws_what_a_train_needs(spark, monkeypatch):
    """No rows are made for intervals that no train could need, and the times are those of whole chunks."""
    from dischargelab.operators import simulate as SI

    made, sums = [], SI.running_sum
    monkeypatch.setattr(SI, "running_sum", lambda df, *a, **k: (made.append(df.count()), sums(df, *a, **k))[1])
    units = spark.createDataFrame([(u, r) for u, r in ((0, 0.1), (1, 2.0), (2, 150.0))], "u int, rate_hz double")
    got = SI.gamma_train(units, ["u"], 10.0, 10.0, 3).toPandas().sort_values(["u", "seq"])
    assert made[0] == 37 + 69 + 1679  # of 4096 in whole chunks
    seeds = {(r["u"], r["c"]): r["s"] for r in units.select("u", F.explode(F.array(F.lit(0), F.lit(1))).alias("c")).withColumn(
        "s", F.xxhash64(F.lit(3), "u", "c")).collect()}
    for u, hz in ((1, 2.0), (2, 150.0)):
        isi = np.concatenate([np.random.default_rng(abs(seeds[u, c])).gamma(10.0, 1 / (hz * 10), 1024) for c in (0, 1)])
        t = np.cumsum(isi)
        assert np.allclose(got.loc[got["u"] == u, "t"], t[t < 10.0])


def test_density_any_block(spark, monkeypatch):
    """Tiles give the clusters of one whole tree, whatever the blocks; no pool is refused for its size."""
    from dischargelab.functions.graphs import hdbscan

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in (0, 3, 6)] + [rng.uniform(-2, 8, (40, 2)), np.full((20, 2), 9.0)])
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "spike_id": range(len(x)), "x": list(x)})).withColumn("g", F.col("g").cast("int"))
    want = hdbscan(x, 5)
    monkeypatch.setattr(C, "SINGLE_TASK_ROWS", 10, raising=False)
    assert want.max() >= 3 and len(set(want[-20:])) == 1 and want[-1] >= 0
    for rows in (17, 4096):
        monkeypatch.setattr(C, "BLOCK", rows)
        monkeypatch.setattr(TI, "BLOCK_ROWS", rows)
        got = C.cluster(df, 0, 42, "hdbscan").orderBy("spike_id").toPandas()["label"].to_numpy()
        assert (got == want).all()
    spins = C.cluster(df, 0, 42, "spc", n_temps=3, mc_steps=10).toPandas()
    assert sorted(spins["spike_id"]) == list(range(len(x)))


def test_fits_read_blocks_that_are_dealt_over_the_cores(spark):
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=(900, 3)), rng.integers(0, 2, 900)
    df = spark.createDataFrame([(int(p), i, v.tolist()) for i, (p, v) in enumerate(zip(g, x))], "g int, spike_id long, x array<double>").coalesce(1)
    blocks = FT.packed(df, "spike_id")
    assert blocks.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert blocks.count() < 900 / 4
    fn = lambda groups: ((v, np.r_[len(a), a.sum(0)]) for v, a in groups)
    got = FT.pass_sums(blocks, fn)
    assert all(np.allclose(got[p], np.r_[(g == p).sum(), x[g == p].sum(0)]) for p in (0, 1))


def test_silhouette_hands_on_sums_of_scores_not_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(0, i, rng.normal(size=3).tolist(), [int(i % 2), int(i % 3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, sid long, x array<double>, labels array<int>")
    found = TI.silhouette(df, "sid", 2, block=50)
    kernel = [n for n in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in n]
    assert len(kernel) == 1 and "sums" not in kernel[0] and "total" in kernel[0]
    assert {r["n"] for r in found.collect()} == {400}


def test_gap_pass_hands_on_sums_per_type_and_reference(monkeypatch):
    rng = np.random.default_rng(6)
    data = {t: np.c_[rng.integers(0, 1 << 50, 200).astype(float), rng.normal(size=(200, 5)) + t] for t in range(4)}
    moments = GP.type_moments(data)
    pools = [GP.make_pool((a, b), moments) for a in range(4) for b in range(a + 1, 4)]
    GP._boxes(data, pools)
    widths, sums = [], GP.pass_sums

    def counted(*args):
        found = sums(*args)
        widths.append(len(found))
        return found

    monkeypatch.setattr(GP, "pass_sums", counted)
    one, two = GP._dispersions(data, data, pools, 6, 10, True)
    assert max(widths) <= 4 * 6 + 2 * len(pools)  # one sum per type and reference, one per type and observed pool
    assert (two < one).all()


def test_regularity_groups_share_calls(spark, monkeypatch):
    """Many groups are worked on in one call, and a group that is spread over batches is still one."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({
        "k": np.arange(90) % 7, "spike_id": range(90), "t": rng.uniform(0, 40, 90), "label": rng.integers(0, 3, 90).astype("int32"),
        "x": rng.normal(0, 1, (90, 2)).tolist()}))

    def costs():
        return C.regularity_costs(df, ["k"], [0, 1, 2], 0.3, 5.0, slot_windows=2)

    assert "FlatMapGroupsInPandas" not in costs()._jdf.queryExecution().toString()
    want = costs().toPandas().sort_values(["spike_id", "c"], ignore_index=True)
    monkeypatch.setattr(C, "REGULARITY_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = costs().toPandas().sort_values(["spike_id", "c"], ignore_index=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(got[["k", "spike_id", "old", "c", "cost"]], want[["k", "spike_id", "old", "c", "cost"]])


def passes_over_tables(monkeypatch, module):
    """Counts the passes that a module starts from the driver as jobs over a table."""
    made, sums = [], module.pass_sums

    def counted(data, *args):
        made.extend([1] if hasattr(data, "sparkSession") else [])
        return sums(data, *args)

    monkeypatch.setattr(module, "pass_sums", counted)
    return made


def test_fits_over_few_bytes_are_dealt_whole_to_tasks(spark, monkeypatch):
    """No pass of a fit over a small table is a job of its own, and the fits are those of the passes."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i % 2, i, (rng.normal(size=3) + 4 * (i % 3)).tolist()) for i in range(600)], "g int, spike_id long, x array<double>")
    made = passes_over_tables(monkeypatch, FT)
    got = [FT.kmeans(df, "spike_id", [2, 3], 1), FT.mixture(df, "spike_id", [2, 3], 1, n_init=2), FT.mixture(df, "spike_id", [3], 1, dof=4.0)]
    assert not made
    monkeypatch.setattr(FT, "held", lambda blocks, n_fits: blocks)
    want = [FT.kmeans(df, "spike_id", [2, 3], 1), FT.mixture(df, "spike_id", [2, 3], 1, n_init=2), FT.mixture(df, "spike_id", [3], 1, dof=4.0)]
    assert made
    for a, b in zip(got, want):
        assert a.keys() == b.keys()
        for key in a:
            assert np.isclose(a[key].score, b[key].score)
            assert np.allclose(np.sort(a[key].centers, axis=0), np.sort(b[key].centers, axis=0))


def test_gap_references_over_few_bytes_are_dealt_whole_to_tasks(spark, monkeypatch):
    """Moments and boxes are the only passes over a small table, and the verdicts are those of the passes, also where only hashes are few."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i % 3, i, (rng.normal(size=6) + 3 * (i % 3 == 2)).tolist()) for i in range(240)], "label int, spike_id long, x array<double>")
    made = passes_over_tables(monkeypatch, GP)
    got = GP.pair_verdicts(df, n_refs=5)
    assert len(made) == 2
    monkeypatch.setattr(GP, "held", lambda blocks, n_fits: blocks)
    partly = GP.pair_verdicts(df, n_refs=5)
    monkeypatch.setattr(GP, "broadcast_bytes", lambda spark: 0)
    want = GP.pair_verdicts(df, n_refs=5)
    for a, b, c in zip(got, partly, want, strict=True):
        assert a["one"] == b["one"] == c["one"]
        assert all(np.isclose(a[k], c[k]) and np.isclose(b[k], c[k]) for k in ("gap1", "gap2", "s1", "s2"))
