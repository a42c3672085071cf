"""End-to-end sorts composed from the operators.

A recording set is a trace DataFrame (run_id, i, v). Stages are lazy; what a later decision reads
more than once is checkpointed. ``joint=True`` clusters all runs as one pool (detection and
refractory clean-up stay per run), otherwise every run is its own pool and all runs advance
together in the same jobs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dischargelab.operators import cluster as C
from dischargelab.operators import features as FE
from dischargelab.operators import gap as GP
from dischargelab.operators import linkage as L
from dischargelab.operators import packed as PK
from dischargelab.operators import shapes as S
from dischargelab.operators import signal as G
from dischargelab.operators import splits as SP
from dischargelab.operators import templates as TP
from dischargelab.operators import trains as TR
from dischargelab.params import BASE, CLINICAL, SIMULATED_FULL, SIMULATED_REDUCED, SortParams
from dischargelab.session import attach, materialize
from dischargelab.sources.traces import concatenate, through_text

RUN = ["run_id"]


@dataclass
class Sort:
    """Result of a sort: spikes (run_id, spike_id, i, t, amp, label, x, features, ...) and logs."""

    spikes: DataFrame
    params: SortParams
    n_clusters: dict[int, int] = field(default_factory=dict)
    scores: DataFrame | None = None
    thresholds: DataFrame | None = None
    measured: DataFrame | None = None
    durations: DataFrame | None = None
    detections: DataFrame | None = None
    rejected: DataFrame | None = None
    raw_types: DataFrame | None = None
    dropped: dict[str, int] = field(default_factory=dict)


# --- stages -------------------------------------------------------------------------------------

def detect_waveforms(trace: DataFrame, p: SortParams) -> Sort:
    """Detection and waveform cut of every run; spike ids encode run number and sample."""
    found = G.detect(trace, RUN, p.fs, p.highpass_hz, p.threshold_mad, p.refractory_ms, p.smoothing_ms, p.noise_baseline_samples)
    packed = found["packed"]
    measured = materialize(PK.zero_phase_blocks(packed, RUN, "bandpass", *p.measure_band, p.fs))
    half, base = (int(round(ms * 1e-3 * p.fs)) for ms in (p.window_ms, p.baseline_window_ms))
    peaks = materialize(found["peaks"])
    cut = G.cut_blocks(measured, peaks, RUN, half, base)
    amp = PK.at_peaks(packed, peaks, RUN, 0, 1, lambda w, lo, i: float(w[0]), T.DoubleType()).withColumnRenamed("got", "amp")
    size = packed.groupBy("run_id").agg(F.sum(F.size("v")).alias("n_samples"))
    runs = size.withColumn("_rn", F.row_number().over(Window.orderBy("run_id")).cast("long"))  # one row per run
    bits = int(size.agg(F.max("n_samples")).first()[0] or 0).bit_length()
    rows = attach(cut.join(amp, ["run_id", "i"]), runs.select("run_id", "_rn"), RUN)
    rows = rows.select("run_id", "i", (F.col("_rn") * (1 << bits) + F.col("i")).alias("spike_id"),
                       (F.col("i") / p.fs + p.start_s).alias("t"), "amp", "x")
    rows = S.dct_highpass(rows, p.dct_filter_n)
    durations = size.select("run_id", (F.col("n_samples") / p.fs).alias("duration_s"))
    detections = durations.select("run_id").join(peaks.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_detected")), "run_id", "left")
    return Sort(materialize(rows), p, thresholds=found["thresholds"], measured=PK.unpack(measured, RUN), durations=durations,
                detections=materialize(detections.fillna(0, ["n_detected"])))


def reject_small_pools(s: Sort, joint: bool) -> Sort:
    """Set aside runs (or the whole pool) with fewer waveforms than shape components or starting types, and say which."""
    p = s.params
    cut = s.spikes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_cut"))
    per = s.detections.join(s.durations, "run_id").join(cut, "run_id", "left").fillna(0, ["n_cut"])
    if joint:
        total = per.agg(*[F.sum(c).alias(c) for c in ("n_detected", "n_cut", "duration_s")])
        per = per.select("run_id").crossJoin(F.broadcast(total))  # one row
    k0 = F.lit(p.n_clusters) if p.n_clusters else F.greatest(F.ceil(F.col("n_detected") / (F.col("duration_s") * p.max_rate_hz)), F.lit(1))
    small = per.where((F.col("n_cut") < k0) | (F.col("n_cut") < p.n_components + 1))
    s.rejected = materialize(small.select("run_id", "n_detected", "n_cut", F.lit("fewer waveforms than components or types").alias("reason")))
    s.spikes = materialize(s.spikes.join(s.rejected.select("run_id"), "run_id", "left_anti"))
    return s


def add_features(rows: DataFrame, p: SortParams, joint: bool) -> DataFrame:
    """Shape features per pool plus amplitude, duration and polarity, standardized and weighted."""
    pool = C.with_pool(rows, [] if joint else RUN, "x")
    if p.feature_method == "wavelet":
        shaped = FE.wavelet_features(pool, "spike_id", p.n_components, p.wavelet, p.wavelet_level, p.wavelet_clip_percentile, keys=["g"])
    else:  # a layout takes no part in decisions: where the parameters name one, leading components take its place
        shaped = FE.pca_by_pool(pool, p.n_components)
    shaped = S.amplitude_duration(materialize(shaped), p.fs)
    return materialize(FE.assemble(shaped, p.n_components, p.amp_dur_weight, p.polarity_weight, keys=["g"]))


def cluster_pools(rows: DataFrame, p: SortParams, durations: DataFrame, joint: bool,
                  detections: DataFrame | None = None) -> tuple[DataFrame, dict[int, int], DataFrame | None]:
    """Choose a type count per pool and label its spikes; noise rows are removed. The starting count follows
    all detections of a pool, also those whose waveform would cross an edge."""
    data = rows.withColumnRenamed("x", "wave").withColumn("x", F.col("features"))
    method = p.cluster_method
    ks: dict[int, int] = {}
    scores = None
    if method in ("hdbscan", "spc"):
        lab = C.cluster(data.select("g", "spike_id", "x"), 0, p.seed, method, min_cluster_size=p.hdbscan_min_cluster_size,
                        min_samples=p.hdbscan_min_samples, **({} if method == "hdbscan" else dict(
                            n_neighbors=p.spc_knn, q_states=p.spc_q_states, t_min=p.spc_t_min, t_max=p.spc_t_max,
                            n_temps=p.spc_n_temps, mc_steps=p.spc_mc_steps, min_frac=p.spc_min_clus_frac)))
    else:
        per = rows.groupBy("g", "run_id").agg(F.count(F.lit(1)).alias("n")).join(durations, "run_id")
        if detections is not None:
            per = per.drop("n").join(detections.withColumnRenamed("n_detected", "n"), "run_id")
        if joint:  # runs without spikes count towards the pooled duration
            total = durations.agg(F.sum("duration_s")).first()[0]
            size = {0: (detections.agg(F.sum("n_detected")).first()[0] if detections is not None else rows.count(), total)}
        else:
            size = {r["g"]: (r["n"], r["duration_s"]) for r in per.collect()}  # one row per run
        n0 = {g: p.n_clusters or max(1, -int(-n // (p.max_rate_hz * dur))) for g, (n, dur) in size.items()}
        feats = materialize(data.select("g", "spike_id", "x"))
        if p.silhouette_sweep or p.force_k is not None:
            ks, scores = C.choose_k(feats, n0, p.silhouette_max_n, p.seed, method, p.sweep_dof or p.tmix_dof,
                                    p.silhouette_sample, p.force_k)
        else:
            ks = n0
        lab = C.cluster(feats, ks, p.seed, method, p.tmix_dof, p.tmix_iters)
    lab = lab.select("spike_id", "label").where("label >= 0")
    return materialize(rows.join(lab, "spike_id")), ks, scores


def clean_and_merge(rows: DataFrame, p: SortParams, pool: list[str], drop_marks: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Refractory clean-up, latency linkage, shape merge and composite removal, labels dense per pool."""
    dropped = {}
    before = rows.count()
    if p.min_isi_ms > 0:
        rows = materialize(TR.min_isi(rows, RUN + ["label"], p.min_isi_ms * 1e-3).where("keep").drop("keep"))
        dropped["isi"] = before - rows.count()
    if p.link_max_latency_ms > 0:
        stats = L.pair_latency(rows, RUN, p.link_max_latency_ms * 1e-3)
        pairs = materialize(L.linked_pairs(stats, RUN, p.link_min_co_occurrence, p.link_max_latency_std_ms))
        groups = L.components(pairs, RUN)
        if not groups.isEmpty():
            n = rows.count()
            merged = L.relabel_groups(rows, groups, RUN)
            touched = groups.select("run_id").distinct()
            hit = TR.min_isi(merged.join(touched, "run_id", "left_semi"), RUN + ["label"], p.link_max_latency_ms * 1e-3).where("keep").drop("keep")
            rows = materialize(hit.unionByName(merged.join(touched, "run_id", "left_anti")))
            dropped["linked"] = n - rows.count()
    rows = TR.relabel_dense(rows, pool)
    options = dict(explicit=p.l2_merge_threshold, percentile=p.l2_merge_percentile, elbow=p.l2_merge_elbow, fence_k=p.l2_merge_outlier_fence_k)
    if any(v is not None and v is not False for v in options.values()):
        rows = TR.relabel_dense(TP.l2_merge(rows, pool, p.l2_merge_normalize_area, **options), pool)
    rows = materialize(rows)
    if p.drop_superposition:
        shift = int(round(p.superposition_max_shift_ms * 1e-3 * p.fs))
        cands = TP.superposition(materialize(TP.templates(rows, pool)), pool, shift)
        rows = materialize(TP.drop_superposition(rows, cands, pool))
        dropped["composite"] = rows.where("label < 0").count()
        if drop_marks:
            rows = rows.where("label >= 0")
    return rows, dropped


def sort_recordings(trace: DataFrame, params: SortParams = BASE, joint: bool = False) -> Sort:
    """Detection, features, clustering, regularity refinement and clean-up of a set of runs."""
    p = params
    s = reject_small_pools(detect_waveforms(trace, p), joint)
    if s.spikes.isEmpty():
        raise ValueError("no run has enough spikes to be sorted; see its detections or lower threshold_mad")
    rows = add_features(s.spikes, p, joint)
    rows, s.n_clusters, s.scores = cluster_pools(rows, p, s.durations, joint, s.detections)
    s.raw_types = materialize(rows.groupBy("run_id").agg(F.countDistinct("label").alias("raw")))
    pool = ["g"]
    if p.isi_weight > 0 and p.isi_iters > 0:
        wave = rows.withColumnRenamed("x", "wave").withColumn("x", F.col("features"))
        rows = C.regularity_refine(wave, RUN, p.isi_weight, p.isi_window_s, p.isi_iters).drop("x").withColumnRenamed("wave", "x")
    rows = materialize(TR.relabel_dense(rows, pool))
    s.spikes, s.dropped = clean_and_merge(rows, p, pool)
    return s


def type_summary(s: Sort, pool: list[str] | None = None) -> DataFrame:
    """Template metrics, rate and regularity per type."""
    pool = pool or ["g"]
    live = s.spikes.where("label >= 0")
    t = S.muap_metrics(TP.templates(live, pool), s.params.fs, "m")
    cv = TR.isi_cv(live, pool + ["label"]).drop("n_spikes")
    dur = live.select(*pool, "run_id").distinct().join(s.durations, "run_id").groupBy(*pool).agg(F.sum("duration_s").alias("duration_s"))
    return t.join(cv, pool + ["label"]).join(dur, pool).withColumn("firing_rate_hz", F.col("n") / F.col("duration_s")).drop("m", "baseline")


# --- scoring ------------------------------------------------------------------------------------

def score(spikes: DataFrame, truth: DataFrame, keys: list[str], tol_s: float) -> DataFrame:
    """One row per run: detections, types, recovered units and mean purity of live types."""
    m = materialize(L.match_truth(spikes, truth, keys, tol_s))
    summ = L.recovery_summary(L.purity(m.where("label >= 0"), keys), keys)
    n = spikes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_detected"), F.sum(F.when(F.col("label") < 0, 1).otherwise(0)).alias("n_dropped"))
    true = truth.groupBy(*keys).agg(F.countDistinct("unit").alias("n_types_true"))
    return n.join(summ, keys, "left").join(true, keys, "left").select(
        *keys, "n_detected", F.coalesce("n_types", F.lit(0)).alias("n_types_est"), "n_types_true",
        F.coalesce("n_recovered", F.lit(0)).alias("n_true_recovered"), F.col("mean_purity").alias("mean_type_purity"), "n_dropped")


def sweep_and_score(traces: DataFrame, truth: DataFrame, fs: float, tol_s: float = 0.003, features=("tsne", "pca", "wavelet"),
                    methods=("kmeans", "gmm", "tmixture"), post=("full", "reduced"), baseline_s: float = 1.0, extra_k: int = 10,
                    max_units: int = 10, **changes) -> DataFrame:
    """Sort the same recordings under every setting and score each run against its truth.

    All recordings of a setting are sorted together. Detection reads the trace as it would come
    back from a text file with six decimals.
    """
    read = materialize(through_text(traces))
    out = None
    for f in features:
        for m in methods:
            for pp in post:
                base = SIMULATED_FULL if pp == "full" else SIMULATED_REDUCED
                p = base.having(fs=fs, feature_method=f, cluster_method=m, silhouette_max_n=max_units + extra_k,
                                noise_baseline_samples=int(round(baseline_s * fs)) if baseline_s > 0 else None, **changes)
                s = sort_recordings(read, p)
                row = score(s.spikes.select("run_id", "spike_id", "t", "label"), truth, RUN, tol_s).select(
                    "run_id", F.lit(f).alias("feature_method"), F.lit(m).alias("method"), F.lit(pp).alias("postprocessing"), "n_detected",
                    "n_types_est", "n_types_true", "n_true_recovered", "mean_type_purity", "n_dropped")
                out = row if out is None else out.unionByName(row)
    return out


def merge_stages(raw: DataFrame, post: DataFrame, merged: DataFrame, truth: DataFrame, tol_s: float) -> DataFrame:
    """One row per run: true types, and types, recovered units and mean purity as labels go from raw (run_id, raw: number of
    types) through post-processing to the merge (both spikes with labels). Purities have three decimals; a run that loses
    all its spikes keeps its row with zeros."""
    actual = truth.groupBy("run_id").agg(F.countDistinct("unit").alias("actual"))
    out = raw.join(actual, "run_id", "left").fillna(0, ["actual"])
    for name, rows in (("post", post), ("merged", merged)):
        live = rows.where("label >= 0").select("run_id", "spike_id", "t", "label")
        got = L.recovery_summary(L.purity(L.match_truth(live, truth, RUN, tol_s), RUN), RUN)
        got = got.select("run_id", F.col("n_types").alias(name), F.col("n_recovered").alias(f"rec_{name}"), F.round("mean_purity", 3).alias(f"purity_{name}"))
        out = out.join(got, "run_id", "left").fillna(0, [name, f"rec_{name}", f"purity_{name}"])
    return out


def merge_effect(s: Sort, truth: DataFrame, tol_s: float, n_refs: int = GP.N_REFS, test: str = "gap") -> DataFrame:
    """The merge table of one pool, one row per run: K, method, actual, raw, post and merged types, recovered units and purity
    before and after the anchored merge."""
    before = s.spikes.where("label >= 0")
    merged, _ = gap_anchor_merge(before, n_refs, test=test)
    rows = merge_stages(s.raw_types, before, merged, truth, tol_s)
    return rows.select("run_id", F.col("actual").alias("K"), F.lit(s.params.cluster_method).alias("method"), "actual", "raw", "post", "merged",
                       "rec_post", "purity_post", "rec_merged", "purity_merged")


def compare_manifest(spikes: DataFrame, truth: DataFrame, params: SortParams, tol_s: float) -> DataFrame:
    """One row per run and estimated type (label >= 0): settings, size, the true unit it matches with its purity, and the two
    types it is a sum of where it is a composite. ``spikes`` holds (run_id, spike_id, t, label, x)."""
    p = params
    live = spikes.where("label >= 0")
    est = L.purity(L.match_truth(live.select("run_id", "spike_id", "t", "label"), truth, RUN, tol_s), RUN)
    units = truth.groupBy("run_id").agg(F.countDistinct("unit").alias("n_muaps_in_trace"))
    shift = int(round(p.superposition_max_shift_ms * 1e-3 * p.fs))
    sums = TP.superposition(materialize(TP.templates(live, RUN)), RUN, shift).select(
        "run_id", F.col("type_c").alias("label"), F.concat_ws("+", "type_i", "type_j").alias("_of"), "pair_residual_frac")
    rows = est.join(sums, ["run_id", "label"], "left").join(units, "run_id", "left")
    return rows.select(
        "run_id", F.coalesce("n_muaps_in_trace", F.lit(0).cast("long")).alias("n_muaps_in_trace"), F.lit(p.feature_method).alias("feature_method"),
        F.lit(p.n_components).cast("long").alias("n_components"), F.lit(p.cluster_method).alias("cluster_method"), F.col("label").alias("estimated_type"),
        "n_spikes", F.col("est_match").alias("matched_true_unit"), F.round("purity", 3).alias("purity"), F.col("_of").isNotNull().alias("is_superposition"),
        F.coalesce("_of", F.lit("")).alias("superposition_of"), F.round("pair_residual_frac", 3).alias("superposition_pair_residual"))


# --- second stages ------------------------------------------------------------------------------

def number_types(spikes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, _id): one number for every type of every pool; the table has a row per type."""
    return materialize(spikes.select(*keys, "label").distinct().withColumn("_id", (F.row_number().over(Window.orderBy(*keys, "label")) - 1).cast("int")))


def pair_tests(spikes: DataFrame, test: str, n_refs: int, owner: dict[int, object] | None = None, floor: float = 0.5) -> list[dict]:
    """Which pairs of types are one cluster: by the gap statistic ("gap"), or because the two-way silhouette of the pair stays below
    ``floor`` ("silhouette"). Pools too small to be tested are one. With ``owner`` only types of the same pool make pairs."""
    if test == "gap":
        return GP.pair_verdicts(spikes, n_refs=n_refs, owner=owner)
    if test != "silhouette":
        raise ValueError(f"unknown merge test {test!r}")
    size = {r["label"]: r["count"] for r in spikes.groupBy("label").count().collect()}  # one row per type
    types = sorted(size)
    pairs = [(a, b) for n, a in enumerate(types) for b in types[n + 1:] if owner is None or owner[a] == owner[b]]
    sil = SP.pairs_one_cluster(spikes, pairs, floor)
    return [{"anchor": a, "other": b, "n_pool": size[a] + size[b], "one": sil[a, b] is None or sil[a, b] < floor, "silhouette": sil[a, b]}
            for a, b in pairs]


def gap_anchor_merge(spikes: DataFrame, n_refs: int = GP.N_REFS, keys: list[str] | None = None, test: str = "gap") -> tuple[DataFrame, list[dict]]:
    """Anchored merge by the named test of pairs; labels must be dense. With ``keys`` every pool merges its own types,
    and the pairs of all pools are tested together."""
    if keys:
        names = number_types(spikes, keys)
        types = [(tuple(r[k] for k in keys), r["_id"]) for r in names.orderBy("_id").collect()]
        owner = {i: pool for pool, i in types}
        apart = attach(spikes, names, [*keys, "label"]).withColumn("label", F.col("_id"))
        log = pair_tests(apart.drop("_id"), test, n_refs, owner)
        one = {(r["anchor"], r["other"]): r["one"] for r in log}
        new, asked = {}, set()
        for pool in dict.fromkeys(owner.values()):
            own = [i for i, p in owner.items() if p == pool]
            ids, order = GP.anchor_merge(len(own), {(a, b): one[i, j] for a, i in enumerate(own) for b, j in enumerate(own) if i < j})
            new.update(zip(own, ids))
            asked |= {(own[a], own[b]) for a, b, _ in order}
        table = spikes.sparkSession.createDataFrame(list(new.items()), "_id int, _new int")
        merged = attach(apart, table, ["_id"]).withColumn("label", F.col("_new")).select(*spikes.columns)
        return merged, [r for r in log if (r["anchor"], r["other"]) in asked]
    log = pair_tests(spikes, test, n_refs)
    n = 1 + int(spikes.agg(F.max("label")).first()[0])
    ids, order = GP.anchor_merge(n, {(r["anchor"], r["other"]): r["one"] for r in log})
    asked = {(a, b) for a, b, _ in order}
    remap = F.array(*[F.lit(i) for i in ids])
    return (spikes.withColumn("label", F.get(remap, F.col("label").cast("int"))),
            [r for r in log if (r["anchor"], r["other"]) in asked])


def split_then_merge(s: Sort, keys: list[str] | None = None, how: str = "silhouette") -> tuple[DataFrame, list[dict]]:
    """Second stage: split heterogeneous types (``how``: "silhouette" or "gap"), then merge near-identical shapes of the same
    pool (``keys``).

    Equal labels of different pools are different types: they are numbered apart before the split. The report names types by
    pool and label.
    """
    live = s.spikes.where("label >= 0")
    if keys:
        names = number_types(live, keys)
        live = attach(live, names, [*keys, "label"]).withColumn("label", F.col("_id")).select(*live.columns)
    if how == "gap":
        split, report = SP.split_by_gap(live)
    else:
        raw, rep = SP.split_by_silhouette(live)
        split, report = materialize(TR.relabel_dense(raw, []).select(*raw.columns)), [r.asDict() for r in rep.collect()]
    if keys:  # one row per type
        named = {r["_id"]: {**{k: r[k] for k in keys}, "type": r["label"]} for r in names.collect()}
        report = [{**r, **named[r["type"]]} if r.get("round", 0) == 0 else r for r in report]
    merged = TP.l2_merge_stage(split, keys or [], s.params.fs)
    return TR.relabel_dense(merged, keys or []).select(*live.columns), report


def sort_subject(trace: DataFrame, params: SortParams = CLINICAL, n_refs: int = GP.N_REFS, template_ms: float = 10.0) -> dict[str, DataFrame]:
    """All runs of one subject laid end to end: sort, clean, anchored merge, and a table per stage."""
    whole, bounds = concatenate(trace.withColumn("subject", F.lit("all")), ["subject"])
    run = materialize(whole.select(F.lit("all").alias("run_id"), "i", "v"))
    s = sort_recordings(run, params)
    post = materialize(TR.relabel_dense(s.spikes.where("label >= 0"), ["g"]))
    merged, log = gap_anchor_merge(post, n_refs)
    merged = materialize(merged)
    tables = None
    for stage, rows in (("postproc", post), ("merged", merged)):
        t = S.muap_metrics(G.reaverage(s.measured, rows.select("run_id", "t", "label"), RUN, params.fs, template_ms), params.fs, "m")
        t = t.select(F.lit(stage).alias("stage"), F.col("label").alias("type"), F.col("n").alias("n_spikes"),
                     F.round("amplitude", 1).alias("p2p_amplitude"), F.round("duration_ms", 2).alias("duration_ms"))
        tables = t if tables is None else tables.unionByName(t)
    labels = post.select("spike_id", "t", F.col("label").alias("pp_label")).join(
        merged.select("spike_id", F.col("label").alias("merged_label")), "spike_id")
    return {"summary": tables, "spikes": labels, "bounds": bounds}


def subject_library(trace: DataFrame, params: SortParams, meta: DataFrame, keep: DataFrame | None = None, template_ms: float = 10.0) -> DataFrame:
    """Curated template library of one subject's runs: pooled sort, wide re-cut, one entry per type."""
    from dischargelab.operators.density import curated_keep

    s = sort_recordings(trace, params, joint=True)
    half, base = (int(round(ms * 1e-3 * params.fs)) for ms in (template_ms, params.baseline_window_ms))
    wide = G.wide_recut(s.measured, s.spikes.select("run_id", "i", "spike_id", "t", "label"), RUN, half, base)
    types = S.muap_metrics(TP.templates(wide, []), params.fs, "m")
    runs = wide.groupBy("label").agg(F.countDistinct("run_id").alias("n_runs_present"))
    total = s.durations.agg(F.sum("duration_s").alias("_d"))
    out = types.join(runs, "label").crossJoin(total).crossJoin(meta)  # one row each on the right
    out = out.select("subject", "category", "muscle", "side", F.col("label").alias("type_idx"), F.col("n").alias("n_spikes"), "n_runs_present",
                     F.lit(params.fs).alias("fs"), "duration_ms", "amplitude", (F.col("n") / F.col("_d")).alias("firing_rate_hz"), "phases",
                     "turns", F.col("m").alias("waveform"))
    return out if keep is None else curated_keep(out, keep)
