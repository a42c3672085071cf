"""Queries over discharge trains, linkage and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from dischargelab.operators import linkage as L
from dischargelab.operators import trains as TR
from dischargelab.plans.fixtures import SPK, TRUTH, spikes, truth
from dischargelab.plans.pipelines import merge_stages as merge_stages_of
from dischargelab.plans.registry import query, rnd
from dischargelab.session import attach

DAY30 = 30 * 86400.0
T_MIN = 21600.0
TRAIN = ["run_id", "label"]

# Greedy removal, one step per rank and train; the kept times are carried in a list.
GREEDY = """rk AS (
  SELECT {key}, t, spike_id, row_number() OVER (PARTITION BY {key} ORDER BY abs(amp) DESC, t, spike_id) AS rn FROM {src}),
{name} AS (
  SELECT {key}, rn, spike_id, t, TRUE AS keep, [t] AS kept FROM rk WHERE rn = 1
  UNION ALL
  SELECT {rkey}, r.rn, r.spike_id, r.t,
         len(list_filter(g.kept, lambda x: abs(x - r.t) < {tmin})) = 0,
         CASE WHEN len(list_filter(g.kept, lambda x: abs(x - r.t) < {tmin})) = 0
              THEN list_append(g.kept, r.t) ELSE g.kept END
  FROM {name} g JOIN rk r ON {join} AND r.rn = g.rn + 1)"""


def greedy_sql(key: list[str], src: str, tmin: float, name: str = "gr") -> str:
    return GREEDY.format(
        key=", ".join(key), rkey=", ".join(f"r.{k}" for k in key), src=src, tmin=f"{tmin!r}::DOUBLE",
        name=name, join=" AND ".join(f"r.{k} = g.{k}" for k in key))


@query("min_isi", f"""WITH RECURSIVE {SPK}, {greedy_sql(TRAIN, 'spk', T_MIN)}
SELECT spike_id, run_id, label, keep FROM gr""")
def min_isi(spark, d):
    return TR.min_isi(spikes(spark, d), TRAIN, T_MIN).select("spike_id", "run_id", "label", "keep")


def flagship(spark, d):
    """Refractory clean-up, then count, rate and regularity per train."""
    kept = TR.min_isi(spikes(spark, d), TRAIN, T_MIN).where("keep")
    out = TR.isi_cv(kept, TRAIN)
    return out.withColumn("rate_hz", F.col("n_spikes") / DAY30)


query("clean_train_stats", f"""WITH RECURSIVE {SPK}, {greedy_sql(TRAIN, 'spk', T_MIN)},
d AS (SELECT run_id, label, t - lag(t) OVER (PARTITION BY run_id, label ORDER BY t, spike_id) AS isi FROM gr WHERE keep)
SELECT run_id, label, count(*) AS n_spikes,
  CASE WHEN count(*) >= 3 AND avg(isi) > 0 THEN {rnd('stddev_pop(isi) / avg(isi)')} END AS isi_cv,
  {rnd('count(*) / 2592000.0', 9)} AS rate_hz FROM d GROUP BY ALL""", digits=9)(
    lambda spark, d: flagship(spark, d).withColumn("isi_cv", F.round("isi_cv", 6)))


@query("isi", f"""WITH {SPK}, d AS (
  SELECT run_id, label, spike_id, (t - lag(t) OVER (PARTITION BY run_id, label ORDER BY t, spike_id)) * 1000.0::DOUBLE AS isi_ms FROM spk)
SELECT run_id, label, spike_id, {rnd('isi_ms', 3)} AS isi_ms FROM d WHERE isi_ms IS NOT NULL""", digits=3)
def isi(spark, d):
    return TR.intervals(spikes(spark, d), TRAIN).select("run_id", "label", "spike_id", "isi_ms")


@query("isi_cv", f"""WITH {SPK}, d AS (
  SELECT run_id, label, t - lag(t) OVER (PARTITION BY run_id, label ORDER BY t, spike_id) AS isi FROM spk)
SELECT run_id, label, count(*) AS n_spikes,
  CASE WHEN count(*) >= 3 AND avg(isi) > 0 THEN {rnd('stddev_pop(isi) / avg(isi)')} END AS isi_cv
FROM d GROUP BY ALL""")
def isi_cv(spark, d):
    return TR.isi_cv(spikes(spark, d), TRAIN)


HOUR_MS = 3600e3


@query("isi_histogram", f"""WITH {SPK}, d AS (
  SELECT label, (t - lag(t) OVER (PARTITION BY run_id, label ORDER BY t, spike_id)) * 1000.0::DOUBLE AS isi FROM spk),
ax AS (SELECT greatest(least(quantile_cont(isi, 0.99), 1.0e9::DOUBLE), 3 * 7.2e6::DOUBLE) / 0.9::DOUBLE AS x FROM d),
nb AS (SELECT CAST(ceil((x + 7.2e6::DOUBLE) / 7.2e6::DOUBLE) - 1 AS BIGINT) AS n FROM ax),
cb AS (SELECT label, least(CAST(floor(isi / 7.2e6::DOUBLE) AS BIGINT), n - 1) AS bin, count(*) AS n FROM d, nb WHERE isi <= n * 7.2e6::DOUBLE GROUP BY ALL)
SELECT label, bin, coalesce(cb.n, 0) AS n FROM (SELECT DISTINCT label, unnest(range(n)) AS bin FROM d, nb WHERE isi IS NOT NULL) g LEFT JOIN cb USING (label, bin)""")
def isi_histogram(spark, d):
    isis = TR.intervals(spikes(spark, d), TRAIN)
    return TR.isi_histogram(isis, ["label"], 2 * HOUR_MS, 1.0e9)


@query("firing_rate", f"""WITH {SPK} SELECT run_id, label, count(*) AS n_spikes,
  {rnd('count(*) / 2592000.0', 12)} AS rate_hz FROM spk GROUP BY ALL""", digits=12)
def firing_rate(spark, d):
    return TR.firing_rate(spikes(spark, d), TRAIN, DAY30)


@query("n0_floor", f"""WITH {SPK} SELECT run_id, count(*) AS n_spikes,
  greatest(CAST(ceil(count(*) / (1e-5::DOUBLE * 2592000.0::DOUBLE)) AS BIGINT), 1) AS n0 FROM spk GROUP BY ALL""")
def n0_floor(spark, d):
    return TR.cluster_floor(spikes(spark, d), ["run_id"], 1e-5, DAY30)


@query("relabel_dense", """SELECT event_id AS spike_id, user_id AS run_id,
  CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(props->>'$.k' AS BIGINT)) - 1 AS BIGINT) AS label FROM events""")
def relabel_dense(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").alias("spike_id"), F.col("user_id").alias("run_id"),
        F.get_json_object("props", "$.k").cast("long").alias("label"))
    return TR.relabel_dense(ev, ["run_id"])


@query("keep_big_types", f"""WITH {SPK}, c AS (SELECT run_id, label, count(*) AS n FROM spk GROUP BY ALL),
b AS (SELECT run_id, label, CAST(row_number() OVER (PARTITION BY run_id ORDER BY label) - 1 AS BIGINT) AS nl FROM c WHERE n >= 14)
SELECT spike_id, run_id, coalesce(nl, -1) AS label FROM spk LEFT JOIN b USING (run_id, label)""")
def keep_big_types(spark, d):
    return TR.keep_big_types(spikes(spark, d), ["run_id"], 14).select("spike_id", "run_id", "label")


# --- smoothed rates: whole days of all trains, one hour step, two hour kernel ---------------------

DT, SIGMA = 3600.0, 7200.0

RATE = f"""{SPK}, ep AS (SELECT floor(min(t) / 86400) * 86400 AS a, (floor(max(t) / 86400) + 1) * 86400 AS b FROM spk),
gr AS (SELECT a, unnest(range(CAST((b - a) / 3600 AS BIGINT))) AS g FROM ep),
rate AS (
  SELECT run_id, label, g, sum(exp(power((a + g * 3600.0::DOUBLE - t) / 7200.0::DOUBLE, 2) * -0.5)
       / (7200.0::DOUBLE * sqrt(2 * pi()))) AS rate
  FROM spk CROSS JOIN gr GROUP BY ALL)"""
AMPS = "amps AS (SELECT run_id, label, CASE WHEN count(*) >= 10 THEN avg(amp) END AS a, max(amp) - min(amp) AS ptp FROM spk GROUP BY ALL)"
FP = "fp AS (SELECT run_id, g, sum(rate) AS f, sum(coalesce(a, ptp) * rate) AS p FROM rate JOIN amps USING (run_id, label) GROUP BY ALL)"


def _epochs(s):
    day = F.floor(F.col("t") / 86400.0) * 86400.0
    return attach(s.select("run_id").distinct(), s.agg(F.min(day).alias("a"), (F.max(day) + 86400.0).alias("b")), [])


def _rates(spark, d):
    s = spikes(spark, d)
    return TR.gaussian_rate(s, _epochs(s), ["run_id"], "label", DT, SIGMA)


def _power(spark, d):
    s = spikes(spark, d)
    amp = s.groupBy("run_id", "label").agg(
        F.when(F.count(F.lit(1)) >= 10, F.avg("amp")).alias("amp"), (F.max("amp") - F.min("amp")).alias("ptp"))
    return TR.power_of_spikes(s, _epochs(s), amp, ["run_id"], "label", DT, SIGMA)


@query("gaussian_rate", f"WITH {RATE} SELECT run_id, label, CAST(g AS BIGINT) AS g, {rnd('rate', 12)} AS rate FROM rate", digits=12)
def gaussian_rate(spark, d):
    return _rates(spark, d)


@query("power_vs_rate", f"WITH {RATE}, {AMPS}, {FP} SELECT run_id, CAST(g AS BIGINT) AS g, {rnd('f', 9)} AS f, {rnd('p', 9)} AS p FROM fp", digits=9)
def power_vs_rate(spark, d):
    return _power(spark, d)


@query("slope_wedge", f"""WITH {RATE}, {AMPS}, {FP},
s AS (SELECT CAST(run_id % 3 AS BIGINT) AS category, p / f AS s FROM fp WHERE f >= 1e-5::DOUBLE),
m AS (SELECT category, median(s) AS ms FROM s GROUP BY 1),
e AS (SELECT category, ms, coalesce(sqrt(ms * lag(ms) OVER (ORDER BY category)), 0) AS lo,
      coalesce(sqrt(ms * lead(ms) OVER (ORDER BY category)), 'inf'::DOUBLE) AS hi FROM m)
SELECT category, {rnd('max(ms)')} AS median_slope, {rnd('max(lo)')} AS lo, {rnd('least(max(hi), 1e9)')} AS hi,
  count(*) AS n_points, {rnd('avg(CASE WHEN s >= lo AND s < hi THEN 1.0 ELSE 0.0 END) * 100')} AS pct_own
FROM s JOIN e USING (category) GROUP BY category""")
def slope_wedge(spark, d):
    pts = _power(spark, d).withColumn("category", F.col("run_id") % 3)
    return TR.slope_wedges(pts, "category", F.col("category"), 1e-5).withColumn("hi", F.least("hi", F.lit(1e9)))


# --- linkage ------------------------------------------------------------------------------------

LAT, CO, STD = 300.0, 0.37, 165e3

PAIRS = f"""ev AS (SELECT 0 AS run, label, t, spike_id, amp FROM spk),
ty AS (SELECT DISTINCT label AS j FROM ev),
q AS (SELECT label AS i, j, t, spike_id FROM ev JOIN ty ON ev.label <> ty.j),
pv AS (SELECT q.i, q.j, q.t, q.spike_id, e.t AS tp FROM q ASOF LEFT JOIN ev e ON q.j = e.label AND q.t >= e.t),
nx AS (SELECT q.spike_id, q.j, e.t AS tn FROM q ASOF LEFT JOIN ev e ON q.j = e.label AND q.t <= e.t),
la AS (SELECT pv.i AS type_i, pv.j AS type_j, CASE WHEN tp IS NULL OR (tn IS NOT NULL AND abs(t - tn) < abs(t - tp)) THEN tn ELSE tp END - t AS l
       FROM pv JOIN nx USING (spike_id, j)),
lm AS (SELECT type_i, type_j, CASE WHEN abs(l) <= {LAT!r}::DOUBLE THEN l END AS m FROM la WHERE l IS NOT NULL),
st AS (SELECT type_i, type_j, count(*) AS n_i, count(m) AS n_matched, avg(m) * 1000 AS latency_mean_ms,
       stddev_pop(m) * 1000 AS latency_std_ms, median(m) * 1000 AS latency_median_ms, count(m) / count(*) AS co FROM lm GROUP BY ALL)"""
LINKED = f"""lk AS (SELECT a.type_i AS type_a, a.type_j AS type_b, a.n_i AS n_a, b.n_i AS n_b, a.co AS co_ab, b.co AS co_ba,
   a.latency_mean_ms, a.latency_std_ms, CASE WHEN a.co >= b.co THEN a.type_i ELSE a.type_j END AS dependent_type
 FROM st a JOIN st b ON a.type_i = b.type_j AND a.type_j = b.type_i AND a.type_i < a.type_j
 WHERE greatest(a.co, b.co) >= {CO!r}::DOUBLE AND a.latency_std_ms <= {STD!r}::DOUBLE)"""
COMP = """ed AS (SELECT type_a AS x, type_b AS y FROM lk UNION SELECT type_b, type_a FROM lk),
rc AS (SELECT x AS n, x AS r FROM ed UNION SELECT ed.y, rc.r FROM rc JOIN ed ON ed.x = rc.n),
cp AS (SELECT n AS type, min(r) AS grp FROM rc GROUP BY n)"""


def _one_run(spark, d):
    return spikes(spark, d).withColumn("run", F.lit(0).cast("long"))


def _linked(spark, d):
    st = L.pair_latency(_one_run(spark, d), ["run"], LAT)
    return L.linked_pairs(st, ["run"], CO, STD)


@query("pair_latency", f"""WITH {SPK}, {PAIRS} SELECT CAST(type_i AS BIGINT) AS type_i, CAST(type_j AS BIGINT) AS type_j, n_i, n_matched,
  {rnd('co', 3)} AS co_occurrence, {rnd('latency_mean_ms', 3)} AS latency_mean_ms, {rnd('latency_std_ms', 3)} AS latency_std_ms,
  {rnd('latency_median_ms', 3)} AS latency_median_ms FROM st""", digits=3)
def pair_latency(spark, d):
    return L.pair_latency(_one_run(spark, d), ["run"], LAT).drop("run")


@query("linked_pairs", f"""WITH {SPK}, {PAIRS}, {LINKED} SELECT type_a, type_b, n_a, n_b, {rnd('co_ab')} AS co_ab, {rnd('co_ba')} AS co_ba,
  {rnd('latency_mean_ms', 3)} AS latency_mean_ms, {rnd('latency_std_ms', 3)} AS latency_std_ms, dependent_type FROM lk""")
def linked_pairs(spark, d):
    return _linked(spark, d).drop("run").withColumn("latency_mean_ms", F.round("latency_mean_ms", 3)).withColumn(
        "latency_std_ms", F.round("latency_std_ms", 3))


@query("components", f"WITH RECURSIVE {SPK}, {PAIRS}, {LINKED}, {COMP} SELECT type, grp AS \"group\" FROM cp")
def components(spark, d):
    return L.components(_linked(spark, d), ["run"]).drop("run")


@query("merge_linked", f"""WITH RECURSIVE {SPK}, {PAIRS}, {LINKED}, {COMP},
ml AS (SELECT run_id, coalesce(grp, label) AS label, t, amp, spike_id FROM spk LEFT JOIN cp ON cp.type = spk.label),
{greedy_sql(TRAIN, 'ml', LAT)} SELECT spike_id, run_id, label, keep FROM gr""")
def merge_linked(spark, d):
    groups = L.components(_linked(spark, d), ["run"])
    s = L.relabel_groups(_one_run(spark, d), groups, ["run"])
    return TR.min_isi(s, TRAIN, LAT).select("spike_id", "run_id", "label", "keep")


# --- scoring ------------------------------------------------------------------------------------

TOL = 600.0
MATCH = f"""{TRUTH}, ti AS (SELECT run_id, t, min(unit) AS lo, max(unit) AS hi FROM tru GROUP BY ALL),
mp AS (SELECT s.spike_id, s.run_id, s.label, s.t, e.t AS tp, e.lo AS plo, e.hi AS phi FROM spk s ASOF LEFT JOIN ti e ON s.run_id = e.run_id AND s.t >= e.t),
mn AS (SELECT s.spike_id, e.t AS tn, e.lo AS nlo FROM spk s ASOF LEFT JOIN ti e ON s.run_id = e.run_id AND s.t <= e.t),
mt AS (SELECT spike_id, run_id, label, CASE
   WHEN tp IS NOT NULL AND (tn IS NULL OR t - tp <= tn - t) THEN CASE WHEN t - tp <= {TOL!r}::DOUBLE THEN CASE WHEN t = tp THEN plo ELSE phi END ELSE -1 END
   WHEN tn IS NOT NULL AND tn - t <= {TOL!r}::DOUBLE THEN nlo ELSE -1 END AS matched_unit FROM mp JOIN mn USING (spike_id))"""
PUR = """vt AS (SELECT run_id, label, matched_unit, count(*) AS n FROM mt GROUP BY ALL),
tot AS (SELECT run_id, label, sum(n) AS n_spikes FROM vt GROUP BY ALL),
bst AS (SELECT run_id, label, matched_unit, n FROM vt WHERE matched_unit >= 0
        QUALIFY row_number() OVER (PARTITION BY run_id, label ORDER BY n DESC, matched_unit) = 1),
pur AS (SELECT run_id, label, CAST(n_spikes AS BIGINT) AS n_spikes, coalesce(matched_unit, -1) AS est_match, coalesce(n / n_spikes, 0.0) AS purity
        FROM tot LEFT JOIN bst USING (run_id, label))"""


def _matched(spark, d):
    return L.match_truth(spikes(spark, d), truth(spark, d), ["run_id"], TOL)


@query("match_truth", f"WITH {SPK}, {MATCH} SELECT spike_id, run_id, label, matched_unit FROM mt")
def match_truth(spark, d):
    return _matched(spark, d).select("spike_id", "run_id", "label", "matched_unit")


@query("purity", f"WITH {SPK}, {MATCH}, {PUR} SELECT run_id, label, n_spikes, est_match, {rnd('purity')} AS purity FROM pur")
def purity(spark, d):
    return L.purity(_matched(spark, d), ["run_id"])


@query("recovery_summary", f"""WITH {SPK}, {MATCH}, {PUR} SELECT run_id, count(*) AS n_types,
  count(DISTINCT CASE WHEN est_match >= 0 THEN est_match END) AS n_recovered, {rnd('avg(purity)')} AS mean_purity,
  {rnd('sum(purity * n_spikes) / sum(n_spikes)')} AS weighted_purity FROM pur GROUP BY run_id""")
def recovery_summary(spark, d):
    return L.recovery_summary(L.purity(_matched(spark, d), ["run_id"]), ["run_id"])


@query("confusion", f"""WITH {SPK}, {MATCH}, cf AS (SELECT matched_unit, label, count(*) AS n FROM mt WHERE matched_unit >= 0 GROUP BY ALL)
SELECT matched_unit, label, coalesce(n, 0) AS n FROM (SELECT DISTINCT matched_unit FROM cf) CROSS JOIN (SELECT DISTINCT label FROM cf) LEFT JOIN cf USING (matched_unit, label)""")
def confusion(spark, d):
    return L.confusion(_matched(spark, d), [])


@query("best_type_per_unit", f"""WITH {SPK}, {MATCH}, {PUR} SELECT run_id, label, n_spikes, est_match, {rnd('purity')} AS purity,
  row_number() OVER (PARTITION BY run_id, est_match ORDER BY n_spikes DESC, label) AS rank FROM pur WHERE est_match >= 0""")
def best_type_per_unit(spark, d):
    return L.best_type_per_unit(L.purity(_matched(spark, d), ["run_id"]), ["run_id"])


def _stage_sql(name: str, label: str) -> str:
    """Matches, purity and summary of one labelling; names carry the stage."""
    return f"""v_{name} AS (SELECT run_id, {label} AS label, matched_unit, count(*) AS n FROM mt WHERE {label} >= 0 GROUP BY ALL),
p_{name} AS (SELECT run_id, label, coalesce(max(n) FILTER (matched_unit >= 0) / sum(n), 0.0) AS purity,
  arg_max(matched_unit, n * 1000000 - matched_unit) FILTER (matched_unit >= 0) AS est FROM v_{name} GROUP BY ALL),
s_{name} AS (SELECT run_id, count(*) AS n_types, count(DISTINCT est) AS rec, round(avg(purity), 3) AS pur FROM p_{name} GROUP BY run_id)"""


@query("merge_stages", f"""WITH {SPK}, {MATCH}, {_stage_sql('post', 'label - 1')}, {_stage_sql('merged', 'CASE WHEN label > 0 THEN (label - 1) // 2 ELSE -1 END')},
ac AS (SELECT run_id, count(DISTINCT unit) AS actual FROM tru GROUP BY run_id), rw AS (SELECT run_id, count(DISTINCT label) AS raw FROM spk GROUP BY run_id)
SELECT run_id, raw, actual, coalesce(a.n_types, 0) AS post, coalesce(a.rec, 0) AS rec_post, {rnd('coalesce(a.pur, 0)')} AS purity_post,
  coalesce(b.n_types, 0) AS merged, coalesce(b.rec, 0) AS rec_merged, {rnd('coalesce(b.pur, 0)')} AS purity_merged
FROM rw JOIN ac USING (run_id) LEFT JOIN s_post a USING (run_id) LEFT JOIN s_merged b USING (run_id)""")
def merge_stages(spark, d):
    """The merge table of given labellings: type 0 is set aside, then neighbours become one."""
    s = spikes(spark, d)
    raw = s.groupBy("run_id").agg(F.countDistinct("label").alias("raw"))
    post = s.withColumn("label", F.col("label") - 1)
    merged = post.withColumn("label", F.when(F.col("label") >= 0, F.floor(F.col("label") / 2)).otherwise(-1))
    return merge_stages_of(raw, post, merged, truth(spark, d), TOL)
