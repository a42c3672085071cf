"""Queries over sources, sinks, summaries, densities and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dischargelab.functions import arrays as A
from dischargelab.operators import density as DE
from dischargelab.operators import features as FE
from dischargelab.operators import shapes as S
from dischargelab.operators import simulate as SI
from dischargelab.operators import templates as TP
from dischargelab.operators import trains as TR
from dischargelab.plans.fixtures import FS_WAVE, SPK, TPL, WFP, WFS, spikes, table, truth, waveforms
from dischargelab.plans.pipelines import score
from dischargelab.plans.q_shapes import ADP, FENCE, PL, T_, _pairs, _terms
from dischargelab.plans.q_trains import _linked, LINKED, MATCH, PAIRS, PUR
from dischargelab.plans.registry import query, rnd
from dischargelab.sources import traces as SRC

# --- sources and sinks --------------------------------------------------------------------------


@query("rate_lookup", """SELECT o_orderkey AS run, coalesce(1000.0::DOUBLE + c_nationkey, 24000.0::DOUBLE) AS fs
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) c ON o_custkey = c_custkey""")
def rate_lookup(spark, d):
    header = table(spark, d, "customer").where("c_acctbal > 2000").select(
        F.col("c_custkey").alias("file"), (F.col("c_nationkey") + 1000.0).alias("fs"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("file"))
    return SRC.with_sample_rate(runs, header).select("run", "fs")


@query("glob_runs", "SELECT 'events.parquet' AS file, count(*) AS n FROM events")
def glob_runs(spark, d):
    rows = spark.read.parquet(f"{d}/event*.parquet").select(F.col("_metadata.file_name").alias("file"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy("file")


@query("run_bounds", f"""WITH {SPK}, n AS (SELECT run_id, label, count(*) AS n FROM spk GROUP BY ALL),
e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY run_id ORDER BY label) AS BIGINT) AS "end" FROM n) SELECT run_id, label, n, "end", "end" - n AS start FROM e""")
def run_bounds(spark, d):
    n = spikes(spark, d).groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return SRC.run_bounds(n, ["run_id"], "label").select("run_id", "label", "n", "end", "start")


@query("library_filter", """SELECT l_returnflag || '_' || l_linestatus AS subject, CAST(l_linenumber AS BIGINT) AS type_idx, count(*) AS n_spikes,
  round(avg(l_quantity), 3) + 0 AS amplitude FROM lineitem GROUP BY ALL HAVING count(*) >= 1000""")
def library_filter(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.count(F.lit(1)).cast("string").alias("n_spikes"), F.round(F.avg("l_quantity"), 3).cast("string").alias("amplitude"))
    stem = F.concat("l_returnflag", F.lit("_"), "l_linestatus", F.lit("_type"), "l_linenumber", F.lit("_"))
    flat = g.select(F.explode(F.array(*[F.struct(F.concat(stem, F.lit(f)).alias("key"), F.col(f).alias("value")) for f in ("n_spikes", "amplitude")])).alias("e")).select("e.*")
    lib = SRC.parse_library(flat, ["n_spikes", "amplitude"], 1000)
    return lib.select("subject", "type_idx", F.col("n_spikes").cast("long").alias("n_spikes"), F.col("amplitude").cast("double").alias("amplitude"))


@query("truth_library_join", """WITH lib AS (SELECT event_type AS subject, user_id AS type_idx, avg(value) AS a FROM events GROUP BY ALL)
SELECT 'unit' || event_id || '_' || event_type || '_type' || user_id AS name, event_type AS subject, user_id AS type_idx, round(a, 6) + 0 AS template_amplitude
FROM events JOIN lib ON event_type = subject AND user_id = type_idx""")
def truth_library_join(spark, d):
    ev = table(spark, d, "events")
    lib = ev.groupBy(F.col("event_type").alias("subject"), F.col("user_id").cast("int").alias("type_idx")).agg(F.avg("value").alias("template_amplitude"))
    units = ev.select(F.concat(F.lit("unit"), "event_id", F.lit("_"), "event_type", F.lit("_type"), "user_id").alias("name"))
    return SRC.join_truth_library(units, lib).select("name", "subject", "type_idx", "template_amplitude")


@query("feature_export", f"""WITH {WFS}, {WFP}, {_terms(2)}, {ADP}, f AS (SELECT spike_id, c0, c1, amplitude AS a, duration_ms AS du, polarity AS po FROM ct JOIN adp USING (spike_id)),
s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in ('c0', 'c1'))} FROM f)
SELECT 'pool' AS run_id, row_number() OVER (ORDER BY spike_id) - 1 AS spike_index, {rnd('spike_id / 24000.0::DOUBLE')} AS time_s, {rnd('x[33]')} AS peak_amplitude_raw,
  {rnd('a')} AS amplitude, {rnd('du')} AS duration_ms, po AS polarity, {rnd('(c0 - m_c0) / s_c0')} AS dct_dim1, {rnd('(c1 - m_c1) / s_c1')} AS dct_dim2, label AS cluster_label
FROM f JOIN wf USING (spike_id), s""")
def feature_export(spark, d):
    rows = S.amplitude_duration(waveforms(spark, d, True), FS_WAVE).withColumn("shape", A.dct_low("x", 2))
    rows = FE.assemble(rows, 2).withColumn("run_id", F.lit("pool")).withColumn("t", F.col("spike_id") / FS_WAVE).withColumn("amp", F.col("x")[32])
    return SRC.feature_table(rows, 2, "dct")


@query("run_type_grid", f"""WITH {SPK}, b AS (SELECT * FROM spk WHERE amp > 100), c AS (SELECT run_id, label, count(*) AS n FROM b GROUP BY ALL)
SELECT r.run_id, l.label, coalesce(n, 0) AS n FROM (SELECT DISTINCT run_id FROM b) r CROSS JOIN (SELECT DISTINCT label FROM b) l LEFT JOIN c ON c.run_id = r.run_id AND c.label = l.label""")
def run_type_grid(spark, d):
    return SRC.run_type_grid(spikes(spark, d).where("amp > 100"))


@query("path_parts", "SELECT o_orderstatus AS subject, o_orderpriority AS muscle, CASE WHEN o_totalprice > 150000 THEN 'Left' ELSE 'Right' END AS side, count(*) AS n FROM orders GROUP BY ALL")
def path_parts(spark, d):
    side = F.when(F.col("o_totalprice") > 150000, "Left").otherwise("Right")
    path = F.concat_ws("/", F.lit("/data"), "o_orderstatus", F.lit("EMG"), "o_orderpriority", side, F.lit("run.txt"))
    return table(spark, d, "orders").select(*SRC.path_parts(path)).groupBy("subject", "muscle", "side").agg(F.count(F.lit(1)).alias("n"))


@query("sort_summary", f"""WITH {SPK}, {MATCH}, {PUR}, tt AS (SELECT run_id, count(DISTINCT unit) AS n_types_true FROM tru GROUP BY run_id)
SELECT run_id, CAST(sum(n_spikes) AS BIGINT) AS n_detected, count(*) AS n_types_est, any_value(n_types_true) AS n_types_true,
  count(DISTINCT CASE WHEN est_match >= 0 THEN est_match END) AS n_true_recovered, {rnd("avg(purity)")} AS mean_type_purity, 0 AS n_dropped
FROM pur JOIN tt USING (run_id) GROUP BY run_id""")
def sort_summary(spark, d):
    return score(spikes(spark, d), truth(spark, d), ["run_id"], 600.0)


# --- summaries ----------------------------------------------------------------------------------

@query("category", """SELECT 'test' || user_id || '_' || event_type AS subject, upper(event_type[1]) || lower(event_type[2:]) AS category, count(*) AS n FROM events GROUP BY ALL""")
def category(spark, d):
    s = F.concat(F.lit("test"), "user_id", F.lit("_"), "event_type")
    return table(spark, d, "events").select(s.alias("subject")).withColumn("category", DE.category(F.col("subject"))).groupBy("subject", "category").agg(F.count(F.lit(1)).alias("n"))


@query("runs_present", f"WITH {SPK} SELECT label, count(DISTINCT run_id) AS n_runs_present, count(*) AS n_spikes FROM spk GROUP BY label")
def runs_present(spark, d):
    return DE.runs_present(spikes(spark, d), "run_id")


@query("library_ordinal", f"WITH {SPK}, t AS (SELECT DISTINCT run_id, label FROM spk) SELECT run_id, label, row_number() OVER (ORDER BY run_id, label) AS ordinal FROM t")
def library_ordinal(spark, d):
    return DE.library_ordinal(spikes(spark, d).select("run_id", "label").distinct(), ["run_id", "label"])


@query("library_index", """SELECT l_returnflag AS subject, l_linestatus AS category, 'm' AS muscle, 's' AS side, CAST(l_linenumber AS BIGINT) AS type_idx, count(*) AS n_spikes,
  count(DISTINCT l_suppkey) AS n_runs_present, 24000.0::DOUBLE AS fs, max(l_quantity) AS duration_ms, max(l_discount) AS amplitude, round(count(*) / 30.0::DOUBLE, 6) + 0 AS firing_rate_hz,
  count(DISTINCT l_tax) AS phases, count(DISTINCT l_discount) AS turns FROM lineitem GROUP BY ALL""")
def library_index(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("subject"), F.col("l_linestatus").alias("category"), F.col("l_linenumber").alias("type_idx")).agg(
        F.count(F.lit(1)).alias("n_spikes"), F.countDistinct("l_suppkey").alias("n_runs_present"), F.max("l_quantity").alias("duration_ms"),
        F.max("l_discount").alias("amplitude"), F.countDistinct("l_tax").alias("phases"), F.countDistinct("l_discount").alias("turns"))
    g = g.withColumn("muscle", F.lit("m")).withColumn("side", F.lit("s")).withColumn("fs", F.lit(FS_WAVE)).withColumn("firing_rate_hz", F.col("n_spikes") / 30.0)
    return SRC.library_index(g)


@query("curated_keep", f"""WITH {SPK}, t AS (SELECT run_id AS subject, label AS type_idx, count(*) AS n FROM spk GROUP BY ALL), k AS (SELECT DISTINCT run_id, label FROM spk WHERE amp > 200)
SELECT * FROM t WHERE subject NOT IN (SELECT run_id FROM k) OR EXISTS (SELECT 1 FROM k WHERE k.run_id = subject AND k.label = type_idx)""")
def curated_keep(spark, d):
    s = spikes(spark, d)
    types = s.groupBy(F.col("run_id").alias("subject"), F.col("label").alias("type_idx")).agg(F.count(F.lit(1)).alias("n"))
    keep = s.where("amp > 200").select(F.col("run_id").alias("subject"), F.col("label").alias("type_idx"))
    return DE.curated_keep(types, keep)


HOUR = "(t - floor(t / 86400.0::DOUBLE) * 86400.0::DOUBLE) / 3600.0::DOUBLE"


def _hours(spark, d):
    return spikes(spark, d).withColumn("hour", (F.col("t") - F.floor(F.col("t") / 86400.0) * 86400.0) / 3600.0)


@query("cov_ellipse", f"""WITH {SPK}, h AS (SELECT label, amp, {HOUR} AS h FROM spk),
s AS (SELECT label, count(*) AS n, avg(amp) AS cx, avg(h) AS cy, var_samp(amp) AS a, covar_samp(amp, h) AS b, var_samp(h) AS c FROM h GROUP BY label)
SELECT label, n, {rnd('cx')} AS cx, {rnd('cy')} AS cy, {rnd('4 * sqrt((a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b))')} AS width,
  {rnd('4 * sqrt((a + c) / 2 - sqrt(power((a - c) / 2, 2) + b * b))')} AS height, {rnd('degrees(atan2(2 * b, a - c) / 2)')} AS angle FROM s""")
def cov_ellipse(spark, d):
    return DE.covariance_ellipse(_hours(spark, d), ["label"], "amp", "hour")


GRID = 12
KDE = f"""st AS (SELECT k, sum(w) AS sw, sum(w * w) AS sw2, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY k HAVING count(*) >= 3),
cv AS (SELECT k, any_value(st.sw) AS sw, power(any_value(sw) * any_value(sw) / any_value(sw2), -1.0::DOUBLE / 3.0::DOUBLE) / (any_value(sw) - any_value(sw2) / any_value(sw)) AS f,
   sum(w * (x - mx) * (x - mx)) AS a, sum(w * (x - mx) * (y - my)) AS b, sum(w * (y - my) * (y - my)) AS c FROM pts JOIN st USING (k) GROUP BY k),
cc AS (SELECT k, sw, a * f AS a, b * f AS b, c * f AS c FROM cv),
gr AS (SELECT k, gx, gy, x0 - 0.2 * (x1 - x0 + 1e-9) + gx * ((x1 - x0) + 0.4 * (x1 - x0 + 1e-9)) / {GRID - 1} AS px,
   greatest(0, y0 - 0.2 * (y1 - y0 + 1e-9)) + gy * (y1 + 0.2 * (y1 - y0 + 1e-9) - greatest(0, y0 - 0.2 * (y1 - y0 + 1e-9))) / {GRID - 1} AS py
   FROM st, (SELECT unnest(range({GRID})) AS gx) g1, (SELECT unnest(range({GRID})) AS gy) g2),
de AS (SELECT gr.k, gx, gy, px, py, sum(w * exp(-0.5 * ((x - px) * (x - px) * c - 2 * (x - px) * (y - py) * b + (y - py) * (y - py) * a) / (a * c - b * b))) / (2 * pi() * sqrt(any_value(a * c - b * b)) * any_value(sw)) AS density
   FROM gr JOIN cc USING (k) JOIN pts ON pts.k = gr.k GROUP BY ALL)"""


@query("kde_2d", f"WITH {SPK}, pts AS (SELECT label AS k, amp AS x, {HOUR} AS y, amp + 1.0::DOUBLE AS w FROM spk), {KDE} "
       f"SELECT k AS label, gx, gy, {rnd('px')} AS x, {rnd('py')} AS y, {rnd('density', 9)} AS density FROM de", digits=9)
def kde_2d(spark, d):
    pts = _hours(spark, d).withColumn("w", F.col("amp") + 1.0)
    out = DE.kde_2d(pts, "label", "amp", "hour", GRID, "w")
    return out.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query("kde_rate_power", f"WITH {SPK}, pts AS (SELECT label % 3 AS k, ln(1 + amp) AS x, log10(1 + amp + run_id) AS y, 1.0::DOUBLE AS w FROM spk WHERE amp >= 5), {KDE} "
       f"SELECT k AS category, gx, gy, {rnd('px')} AS x, {rnd('py')} AS y, {rnd('density', 6)} AS density FROM de")
def kde_rate_power(spark, d):
    pts = spikes(spark, d).where("amp >= 5").select((F.col("label") % 3).alias("category"), F.log(F.col("amp") + 1).alias("f"), F.log10(F.col("amp") + 1 + F.col("run_id")).alias("lp"))
    return DE.kde_2d(pts, "category", "f", "lp", GRID)


ISI = "d AS (SELECT (t - lag(t) OVER (PARTITION BY run_id, label ORDER BY t, spike_id)) / 3600.0::DOUBLE AS v FROM spk), l AS (SELECT v FROM d WHERE v IS NOT NULL)"


def _gaps(spark, d):
    isis = TR.intervals(spikes(spark, d), ["run_id", "label"])
    return isis.select((F.col("isi_ms") / 1000.0 / 3600.0).alias("v"))


@query("hist", f"""WITH {SPK}, {ISI}, r AS (SELECT min(v) AS a, max(v) AS b, (max(v) - min(v)) / 25 AS w FROM l)
SELECT CAST(bin AS BIGINT) AS bin, coalesce(n, 0) AS n, {rnd('a + bin * w', 4)} AS lo, {rnd('a + (bin + 1) * w', 4)} AS hi FROM (SELECT unnest(range(25)) AS bin) CROSS JOIN r
LEFT JOIN (SELECT least(CAST(floor((v - a) / w) AS BIGINT), 24) AS bin, count(*) AS n FROM l, r GROUP BY 1) USING (bin)""", digits=4)
def hist(spark, d):
    return DE.histogram(_gaps(spark, d), "v", 25)


@query("hist_kde", f"""WITH {SPK}, {ISI}, r AS (SELECT min(v) AS a, max(v) AS b, stddev_samp(v) * power(count(*), -0.2::DOUBLE) AS h, count(*) AS n FROM l)
SELECT CAST(g AS BIGINT) AS g, {rnd('any_value(a + g * (b - a) / 49)', 4)} AS x, {rnd('sum(exp(-0.5 * power((a + g * (b - a) / 49 - v) / h, 2))) / any_value(n * h * sqrt(2 * pi()))', 8)} AS density
FROM l, r, (SELECT unnest(range(50)) AS g) GROUP BY g""", digits=8)
def hist_kde(spark, d):
    return DE.kde_1d(_gaps(spark, d), "v", 50).withColumn("x", F.round("x", 4))


@query("category_population", f"""WITH {WFS}, {WFP}, {ADP}, ad AS (SELECT label % 3 AS category, 'spike' AS kind, spike_id AS id, amplitude, duration_ms, 1 AS weight FROM adp JOIN wf USING (spike_id)),
{TPL}, cn AS (SELECT label, count(*) AS n FROM wf GROUP BY label),
bs AS (SELECT label, avg(v) AS mu, stddev_pop(v) AS sd FROM tpl WHERE p < 6 OR p >= 58 GROUP BY label),
oo AS (SELECT label, coalesce(min(CASE WHEN abs(v - mu) > greatest(2.5::DOUBLE * sd, 1e-9) THEN p END), 0) AS a, coalesce(max(CASE WHEN abs(v - mu) > greatest(2.5::DOUBLE * sd, 1e-9) THEN p END), 63) AS b FROM tpl JOIN bs USING (label) GROUP BY label),
ty AS (SELECT label % 3 AS category, 'type' AS kind, label AS id, max(v) - min(v) AS amplitude, any_value(b - a) / 24000.0::DOUBLE * 1000.0::DOUBLE AS duration_ms, any_value(n) AS weight
  FROM tpl JOIN oo USING (label) JOIN cn USING (label) WHERE p BETWEEN a AND b GROUP BY label)
SELECT category, kind, id, {rnd('amplitude')} AS amplitude, {rnd('duration_ms')} AS duration_ms, weight FROM (SELECT * FROM ad UNION ALL SELECT * FROM ty)""")
def category_population(spark, d):
    w = waveforms(spark, d, True)
    cat = (F.col("label") % 3).alias("category")
    each = S.amplitude_duration(w, FS_WAVE).select(cat, F.lit("spike").alias("kind"), F.col("spike_id").alias("id"), "amplitude", "duration_ms", F.lit(1).cast("long").alias("weight"))
    types = S.muap_metrics(TP.templates(w, []), FS_WAVE, "m").select(cat, F.lit("type").alias("kind"), F.col("label").cast("long").alias("id"), "amplitude", "duration_ms", F.col("n").alias("weight"))
    return each.unionByName(types)


@query("report_lines", f"""WITH RECURSIVE {SPK}, {PAIRS}, {LINKED}, {T_}, {PL}, {FENCE.format(k=1.0)}
SELECT 'linked' AS kind, printf('type %d (n=%d) <-> type %d (n=%d): co-occurrence %.0f%%/%.0f%%, latency %+.2f +/- %.2f ms (type %d is the likely secondary lobe)', type_a, n_a, type_b, n_b, co_ab * 100, co_ba * 100, latency_mean_ms, latency_std_ms, dependent_type) AS line FROM lk
UNION ALL SELECT 'close', printf('type %d (n=%d) <-> type %d (n=%d): L2 distance %.2f', type_a, x.n, type_b, y.n, l2) FROM pl JOIN cn x ON x.label = type_a JOIN cn y ON y.label = type_b, fe WHERE l2 <= threshold""")
def report_lines(spark, d):
    linked = DE.linked_lines(_linked(spark, d)).select(F.lit("linked").alias("kind"), "line")
    p = _pairs(spark, d)
    close = DE.close_lines(TP.close_pairs(p, TP.fence_threshold(p, [], 1.0), [])).select(F.lit("close").alias("kind"), "line")
    return linked.unionByName(close)


# --- generators ---------------------------------------------------------------------------------

# The recording spans whole days around all spikes.
@query("superpose", f"""WITH {SPK}, {WFS}, {WFP}, {TPL}, ep AS (SELECT floor(min(t) / 86400) * 86400 AS a, (floor(max(t) / 86400) + 1) * 86400 AS b FROM spk),
s AS (SELECT label, CAST(round_even((t - a) * 0.01::DOUBLE, 0) AS BIGINT) - 32 AS f FROM spk, ep)
SELECT f + p AS i, {rnd('sum(v)')} AS v FROM s JOIN tpl USING (label) WHERE f + p >= 0 AND f + p < (SELECT (b - a) * 0.01::DOUBLE FROM ep) GROUP BY f + p""")
def superpose(spark, d):
    s = spikes(spark, d)
    day = F.floor(F.col("t") / 86400.0) * 86400.0
    a, b = s.agg(F.min(day), F.max(day) + 86400.0).first()
    s = s.select(F.lit("all").alias("rec"), "label", (F.col("t") - a).alias("t"))
    t = TP.templates(waveforms(spark, d, True), []).select("label", F.col("m").alias("x"))
    return SI.superpose(s, t, ["rec"], ["label"], 0.01, round((b - a) * 0.01)).drop("rec")


@query("gamma_train")
def gamma_train(spark, d):
    units = spikes(spark, d).groupBy("run_id", "label").agg((F.count(F.lit(1)) / 100.0).alias("rate_hz"))
    return SI.gamma_train(units, ["run_id", "label"], 100.0, 10.0, 42)


@query("colored_noise")
def colored_noise(spark, d):
    sizes = {r["event_type"]: r["count"] for r in table(spark, d, "events").groupBy("event_type").count().collect()}
    return SI.colored_noise(spark, sizes, 1.0, 42)


@query("build_trace")
def build_trace(spark, d):
    lib = TP.templates(waveforms(spark, d, True), []).select(F.col("label").alias("entry"), F.col("m").alias("x"))
    return SI.build_traces(spark, lib, [3, 5], 2000.0, 5.0, 30.0)["trace"]


