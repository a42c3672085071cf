"""Queries over clustering and model selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from dischargelab.operators import cluster as C
from dischargelab.operators import features as FE
from dischargelab.operators import fits as FT
from dischargelab.operators.sampling import hash_sample
from dischargelab.operators.tiles import silhouette as tile_silhouette
from dischargelab.plans.fixtures import SPK, WF, WFP, WFS, spikes, waveforms
from dischargelab.plans.registry import query, rnd
from dischargelab.session import materialize


def pool(spark, d, dims: int = 4):
    """All waveforms as one pool of low principal-component scores."""
    rows = FE.pca_scores(waveforms(spark, d, True), dims, out="features")
    return materialize(C.with_pool(rows.select("spike_id", "label", "features"), []).select("g", "spike_id", "x"))


def _labelled(spark, d):
    return waveforms(spark, d, True).select(F.lit(0).alias("g"), "spike_id", "x", F.array(F.col("label").cast("int")).alias("labels"))


SIL = """ds AS (SELECT a.spike_id, a.label AS la, b.label AS lb, b.spike_id AS ob, list_distance(a.x, b.x) AS d FROM {src} a JOIN {src} b ON a.spike_id <> b.spike_id),
mn AS (SELECT spike_id, la, lb, sum(d) / count(*) AS m FROM ds GROUP BY ALL),
ab AS (SELECT spike_id, any_value(la) AS la, max(CASE WHEN la = lb THEN m END) AS a, min(CASE WHEN la <> lb THEN m END) AS b FROM mn GROUP BY spike_id),
si AS (SELECT CASE WHEN a IS NULL THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM ab WHERE b IS NOT NULL)"""


@query("silhouette", f"WITH {WFS}, {SIL.format(src='wf')} SELECT {rnd('avg(s)')} AS silhouette, count(*) AS n FROM si")
def silhouette(spark, d):
    return tile_silhouette(_labelled(spark, d), "spike_id").select("silhouette", "n")


SAMPLE = "sm AS (SELECT * FROM wf ORDER BY CAST('0x' || substr(md5('42:' || spike_id), 1, 8) AS BIGINT), spike_id LIMIT 300)"


@query("silhouette_sampled", f"WITH {WFS}, {SAMPLE}, {SIL.format(src='sm')} SELECT {rnd('avg(s)')} AS silhouette, count(*) AS n FROM si")
def silhouette_sampled(spark, d):
    rows = hash_sample(_labelled(spark, d), ["g"], "spike_id", 300, 42)
    return tile_silhouette(rows, "spike_id").select("silhouette", "n")


@query("trial_sample", """SELECT label, spike_id FROM (SELECT CAST(label AS BIGINT) AS label, vec_id AS spike_id,
  row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5('0:' || vec_id), 1, 8) AS BIGINT), vec_id) AS r FROM embeddings) WHERE r <= 40""")
def trial_sample(spark, d):
    return hash_sample(waveforms(spark, d).select("label", "spike_id"), ["label"], "spike_id", 40, 0)


@query("knn_graph", f"""WITH {WF}, ds AS (SELECT a.spike_id AS s, b.spike_id AS o, list_distance(a.x, b.x) AS d FROM wf a JOIN wf b ON a.spike_id <> b.spike_id),
nn AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY s ORDER BY d, o) <= 10),
sc AS (SELECT greatest(avg(d), 1e-9) AS sc FROM (SELECT s, max(d) AS d FROM nn GROUP BY s))
SELECT least(s, o) AS a, greatest(s, o) AS b, {rnd('max(exp(-d * d / (2 * sc * sc)))')} AS weight FROM nn, sc GROUP BY ALL""")
def knn_graph(spark, d):
    rows = waveforms(spark, d).select(F.lit(0).alias("g"), "spike_id", "x")
    return C.knn_graph(rows, 10).drop("g")


@query("best_k", f"""WITH {SPK}, s AS (SELECT run_id, label AS k, round(avg(amp), 0) AS score FROM spk GROUP BY ALL)
SELECT run_id, k, score FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, k) = 1""")
def best_k(spark, d):
    scores = spikes(spark, d).groupBy("run_id", F.col("label").alias("k")).agg(F.round(F.avg("amp"), 0).alias("score"))
    return C.best_k(scores, ["run_id"])


@query("kmeans")
def kmeans(spark, d):
    return C.cluster(pool(spark, d), 10, 42).select("spike_id", "label")


@query("gmm")
def gmm(spark, d):
    return C.cluster(pool(spark, d), 6, 42, "gmm").select("spike_id", "label")


@query("tmixture")
def tmixture(spark, d):
    return C.cluster(pool(spark, d), 6, 42, "tmixture", dof=8.0).select("spike_id", "label")


@query("hdbscan")
def hdbscan(spark, d):
    return C.cluster(pool(spark, d, 2), 0, 42, "hdbscan").select("spike_id", "label")


@query("spc")
def spc(spark, d):
    return C.cluster(pool(spark, d, 3), 0, 42, "spc", n_temps=8, mc_steps=60).select("spike_id", "label")


@query("silhouette_sweep")
def silhouette_sweep(spark, d):
    return C.sweep(pool(spark, d), range(2, 9), 42).select("k", "score")


# One refinement step: features are the amplitude and the hour of day, a day-wide window.
COST = f"""{SPK}, fx AS (SELECT *, amp / 50.0::DOUBLE AS f0, (t - floor(t / 86400.0::DOUBLE) * 86400.0::DOUBLE) / 43200.0::DOUBLE AS f1 FROM spk),
cn AS (SELECT run_id, label, avg(f0) AS m0, avg(f1) AS m1 FROM fx GROUP BY ALL), al AS (SELECT run_id, avg(f0) AS a0, avg(f1) AS a1 FROM fx GROUP BY ALL),
cc AS (SELECT al.run_id, c.c, coalesce(m0, a0) AS m0, coalesce(m1, a1) AS m1 FROM (SELECT run_id, a0, a1, top FROM al JOIN (SELECT run_id, max(label) AS top FROM fx GROUP BY ALL) USING (run_id)) al JOIN (SELECT unnest(range(5)) AS c) c ON c.c <= al.top LEFT JOIN cn ON cn.run_id = al.run_id AND cn.label = c.c),
lc AS (SELECT a.run_id, a.spike_id, b.label AS c, a.t, b.t AS tb FROM fx a JOIN fx b ON a.run_id = b.run_id AND b.spike_id <> a.spike_id AND abs(b.t - a.t) <= 86400.0::DOUBLE),
dd AS (SELECT run_id, spike_id, c, abs(tb - t) AS ad, tb - lag(tb) OVER (PARTITION BY spike_id, c ORDER BY tb) AS df FROM lc),
rt AS (SELECT spike_id, c, count(*) AS n, min(ad) AS isi, median(df) AS md FROM dd GROUP BY ALL),
ct AS (SELECT fx.run_id, fx.spike_id, cc.c, sqrt(power(f0 - m0, 2) + power(f1 - m1, 2)) + 20000.0::DOUBLE * (CASE WHEN n >= 2 THEN
   abs((CASE WHEN isi > 0 THEN 1 / isi ELSE 0 END) - (CASE WHEN md > 0 THEN 1 / md ELSE 0 END)) ELSE 0 END) AS cost
   FROM fx JOIN cc USING (run_id) LEFT JOIN rt ON rt.spike_id = fx.spike_id AND rt.c = cc.c)"""


def _costs(spark, d):
    day = F.col("t") - F.floor(F.col("t") / 86400.0) * 86400.0
    rows = spikes(spark, d).withColumn("x", F.array(F.col("amp") / 50.0, day / 43200.0))
    return rows, C.regularity_costs(rows, ["run_id"], list(range(5)), 20000.0, 86400.0)


@query("regularity_costs", f"WITH {COST} SELECT run_id, spike_id, CAST(c AS BIGINT) AS c, {rnd('cost')} AS cost FROM ct")
def regularity_costs(spark, d):
    return _costs(spark, d)[1].select("run_id", "spike_id", "c", "cost")


# The whole refinement, every step on the labels of the one before; runs with an even number have lost their
# highest types, so that runs differ in their types. The cheapest step of a run counts, the first of equals.
MIXED = "fx0 AS MATERIALIZED (SELECT run_id, spike_id, t, f0, f1, CASE WHEN run_id % 2 = 0 THEN label % 3 ELSE label END AS label FROM fx)"
STEP = """al{k} AS MATERIALIZED (SELECT run_id, avg(f0) AS a0, avg(f1) AS a1 FROM fx{k} GROUP BY ALL),
cn{k} AS MATERIALIZED (SELECT run_id, label, avg(f0) AS m0, avg(f1) AS m1 FROM fx{k} GROUP BY ALL),
cc{k} AS MATERIALIZED (SELECT tp.run_id, c.c, coalesce(m0, a0) AS m0, coalesce(m1, a1) AS m1 FROM tp JOIN (SELECT unnest(range(5)) AS c) c ON c.c <= tp.top
  JOIN al{k} al ON al.run_id = tp.run_id LEFT JOIN cn{k} cn ON cn.run_id = tp.run_id AND cn.label = c.c),
dd{k} AS MATERIALIZED (SELECT spike_id, c, abs(tb - t) AS ad, tb - lag(tb) OVER (PARTITION BY spike_id, c ORDER BY tb) AS df FROM (
  SELECT a.spike_id, b.label AS c, a.t, b.t AS tb FROM fx{k} a JOIN fx{k} b ON a.run_id = b.run_id AND b.spike_id <> a.spike_id AND abs(b.t - a.t) <= 86400.0::DOUBLE)),
rt{k} AS MATERIALIZED (SELECT spike_id, c, count(*) AS n, min(ad) AS isi, median(df) AS md FROM dd{k} GROUP BY ALL),
pk{k} AS MATERIALIZED (SELECT fx.run_id, fx.spike_id, cc.c, sqrt(power(f0 - m0, 2) + power(f1 - m1, 2)) + 20000.0::DOUBLE * (CASE WHEN n >= 2 THEN
   abs((CASE WHEN isi > 0 THEN 1 / isi ELSE 0 END) - (CASE WHEN md > 0 THEN 1 / md ELSE 0 END)) ELSE 0 END) AS cost
   FROM fx{k} fx JOIN cc{k} cc USING (run_id) LEFT JOIN rt{k} rt ON rt.spike_id = fx.spike_id AND rt.c = cc.c
   QUALIFY row_number() OVER (PARTITION BY fx.spike_id ORDER BY cost, cc.c) = 1),
fx{n} AS MATERIALIZED (SELECT fx.run_id, fx.spike_id, t, f0, f1, pk.c AS label FROM fx{k} fx JOIN pk{k} pk USING (spike_id))"""
STEPS = ",\n".join(STEP.format(k=k, n=k + 1) for k in range(5))
TOTALS = " UNION ALL ".join(f"SELECT {k} AS k, run_id, sum(cost) AS tot FROM pk{k} GROUP BY run_id" for k in range(5))
PICKS = " UNION ALL ".join(f"SELECT {k} AS k, run_id, spike_id, c FROM pk{k}" for k in range(5))
REFINED = (f"WITH {COST[:COST.index('cn AS (')]} {MIXED}, tp AS MATERIALIZED (SELECT run_id, max(label) AS top FROM fx0 GROUP BY ALL), {STEPS}, "
           f"best AS (SELECT run_id, k FROM ({TOTALS}) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY tot, k) = 1) "
           f"SELECT run_id, spike_id, CAST(c AS BIGINT) AS label FROM ({PICKS}) JOIN best USING (run_id, k)")


@query("regularity_refine", REFINED)
def regularity_refine(spark, d):
    rows = _costs(spark, d)[0].withColumn("label", F.when(F.col("run_id") % 2 == 0, F.col("label") % 3).otherwise(F.col("label")).cast("int"))
    return C.regularity_refine(rows, ["run_id"], 20000.0, 86400.0).select("run_id", "spike_id", "label")


# --- fits from given starts, step by step --------------------------------------------------------

LLOYD = ", ".join(
    f"""a{k} AS MATERIALIZED (SELECT spike_id, c FROM (SELECT w.spike_id, c.c, sum((w.v - c.v) * (w.v - c.v)) AS d FROM wfp w JOIN c{k} c USING (p) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY spike_id ORDER BY d, c) = 1), c{k + 1} AS MATERIALIZED (SELECT c, p, avg(v) AS v FROM wfp JOIN a{k} USING (spike_id) GROUP BY ALL)""" for k in range(11))


@query("kmeans_given", f"WITH {WFS}, {WFP}, c0 AS MATERIALIZED (SELECT spike_id AS c, p, v FROM wfp WHERE spike_id < 3), {LLOYD} SELECT spike_id, CAST(c AS BIGINT) AS label FROM a10")
def kmeans_given(spark, d):
    """Ten k-means steps over all waveforms from the first three as centers."""
    rows = materialize(waveforms(spark, d, True).select(F.lit(0).alias("g"), "spike_id", "x"))
    start = np.array([r["x"] for r in rows.where("spike_id < 3").orderBy("spike_id").collect()])
    fit = FT.lloyd(rows, [FT.Fit(0, 3, start)], max_iter=10, tol=0.0)[0]
    return FT.assign(rows, {0: fit}).select("spike_id", "label")


HALF_SUMS = "hv AS MATERIALIZED (SELECT spike_id, list_sum(x[1:32]) AS u, list_sum(x[33:64]) AS w FROM wf)"
# A step of two-variable EM: q holds responsibilities r and tail weights t (1 for Gaussian components).
EM_STEP = """e{k} AS MATERIALIZED (SELECT spike_id, c, u, w, ln(wt) - 0.5::DOUBLE * ln(a * d - b * b) AS l0,
  (d * (u - mx) * (u - mx) - 2 * b * (u - mx) * (w - my) + a * (w - my) * (w - my)) / (a * d - b * b) AS mh FROM hv, s{k}),
q{k} AS MATERIALIZED (SELECT spike_id, c, u, w, {tail} AS t, l, exp(l - max(l) OVER (PARTITION BY spike_id)) AS f FROM (SELECT *, l0 {density} AS l FROM e{k})),
r{k} AS MATERIALIZED (SELECT *, f / sum(f) OVER (PARTITION BY spike_id) AS r FROM (SELECT q.*, {tail_of} AS tt FROM q{k} q)),
m{k} AS MATERIALIZED (SELECT c, sum(r) AS nk, sum(r * tt) AS s0, sum(r * tt * u) / sum(r * tt) AS mx, sum(r * tt * w) / sum(r * tt) AS my FROM r{k} GROUP BY c),
s{n} AS MATERIALIZED (SELECT m.c, any_value(m.mx) AS mx, any_value(m.my) AS my, sum(r * tt * (u - m.mx) * (u - m.mx)) / any_value(nk) + 1e-6 AS a, sum(r * tt * (u - m.mx) * (w - m.my)) / any_value(nk) AS b,
  sum(r * tt * (w - m.my) * (w - m.my)) / any_value(nk) + 1e-6 AS d, any_value(nk) / (SELECT count(*) FROM hv) AS wt FROM r{k} r JOIN m{k} m USING (c) GROUP BY m.c)"""


def _em_sql(dof, steps: int) -> str:
    density = "- 0.5::DOUBLE * mh" if dof is None else f"- 0.5::DOUBLE * ({dof} + 2) * ln(1 + mh / {dof})"
    tail = "1" if dof is None else f"({dof} + 2) / ({dof} + mh)"
    body = ", ".join(EM_STEP.format(k=k, n=k + 1, density=density, tail=tail, tail_of="t") for k in range(steps + 1))
    return f"""WITH {WFS}, {HALF_SUMS}, h AS MATERIALIZED (SELECT p.spike_id, p.u, p.w, c.spike_id AS c FROM hv p, hv c WHERE c.spike_id < 2
  QUALIFY row_number() OVER (PARTITION BY p.spike_id ORDER BY (p.u - c.u) * (p.u - c.u) + (p.w - c.w) * (p.w - c.w), c.spike_id) = 1),
s0 AS MATERIALIZED (SELECT h.c, any_value(g.u) AS mx, any_value(g.w) AS my, var_samp(h.u) + 1e-6 AS a, covar_samp(h.u, h.w) AS b, var_samp(h.w) + 1e-6 AS d,
  count(*)::DOUBLE / (SELECT count(*) FROM hv) AS wt FROM h JOIN hv g ON g.spike_id = h.c GROUP BY h.c), {body}
SELECT spike_id, CAST(c AS BIGINT) AS label FROM q{steps} QUALIFY row_number() OVER (PARTITION BY spike_id ORDER BY l DESC, c) = 1"""


def _em_given(spark, d, dof, steps: int):
    halves = F.array(F.aggregate(F.slice("x", 1, 32), F.lit(0.0), lambda a, v: a + v), F.aggregate(F.slice("x", 33, 32), F.lit(0.0), lambda a, v: a + v))
    rows = materialize(waveforms(spark, d, True).select(F.lit(0).alias("g"), "spike_id", halves.alias("x")))
    start = np.array([r["x"] for r in rows.where("spike_id < 2").orderBy("spike_id").collect()])
    fits = [FT.Fit(0, 2, start)]
    FT._hard_moments(rows, fits, 1e-6)
    FT._em(rows, fits, dof, steps, 0.0, 1e-6)
    return FT.assign(rows, {0: fits[0]}, dof=dof).select("spike_id", "label")


@query("gmm_given", _em_sql(None, 8))
def gmm_given(spark, d):
    """Eight EM steps of two Gaussian components over both halves of all waveforms, from given centers."""
    return _em_given(spark, d, None, 8)


@query("tmixture_given", _em_sql(4.0, 8))
def tmixture_given(spark, d):
    return _em_given(spark, d, 4.0, 8)
