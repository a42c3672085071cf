"""Queries over waveforms, templates and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from dischargelab.functions import arrays as A
from dischargelab.operators import features as FE
from dischargelab.operators import shapes as S
from dischargelab.operators import templates as TP
from dischargelab.plans.fixtures import FS_WAVE, TPL, TPLA, WF, WFP, WFS, waveforms
from dischargelab.plans.registry import query, rnd

N = 64
PI = "pi()"


def samples(df, x, keep=("spike_id",)):
    """One row per sample of an array column."""
    return df.select(*keep, F.posexplode(x).alias("p", "v"))


def _cos(k: int, p: str = "p") -> str:
    return f"cos((2 * {p} + 1) * ({k} * {PI}) / 128)"


def _terms(k: int) -> str:
    cols = ", ".join(f"sum(v * {_cos(j)}) * sqrt({1 if j == 0 else 2} / 64.0::DOUBLE) AS c{j}" for j in range(k))
    return f"ct AS (SELECT spike_id, {cols}, sum(v * v) AS e FROM wfp GROUP BY spike_id)"


def _rebuild(k: int) -> str:
    return " + ".join(f"c{j} * sqrt({1 if j == 0 else 2} / 64.0::DOUBLE)" + ("" if j == 0 else f" * {_cos(j)}") for j in range(k))


@query("dct_highpass", f"WITH {WF}, {WFP}, {_terms(2)} SELECT spike_id, p, {rnd(f'v - ({_rebuild(2)})')} AS v FROM wfp JOIN ct USING (spike_id)")
def dct_highpass(spark, d):
    return samples(S.dct_highpass(waveforms(spark, d), 2), "x")


@query("dct_low_terms", f"""WITH {WF}, {WFP}, {_terms(3)}
SELECT spike_id, {rnd('c0')} AS c0, {rnd('c1')} AS c1, {rnd('c2')} AS c2 FROM ct""")
def dct_low_terms(spark, d):
    rows = waveforms(spark, d).withColumn("c", A.dct_low("x", 3))
    return rows.select("spike_id", *[F.col("c")[k].alias(f"c{k}") for k in range(3)])


@query("dct_reconstruct", f"WITH {WF}, {WFP}, {_terms(3)} SELECT spike_id, p, {rnd(_rebuild(3))} AS v FROM wfp JOIN ct USING (spike_id)")
def dct_reconstruct(spark, d):
    rows = waveforms(spark, d).withColumn("y", A.dct_rebuild(A.dct_low("x", 3), F.size("x")))
    return samples(rows, "y")


@query("drift_select", f"""WITH {WF}, {WFP}, {_terms(3)}, f AS (
  SELECT spike_id, CASE WHEN e > 0 THEN (c0 * c0 + c1 * c1 + c2 * c2) / e ELSE 1.0 END AS f FROM ct)
SELECT spike_id, {rnd('f')} AS low_frac, f <= 0.05::DOUBLE AS survived FROM f""")
def drift_select(spark, d):
    return S.drift(waveforms(spark, d), 3, 0.05).select("spike_id", "low_frac", "survived")


BASE = """bs AS (SELECT spike_id, avg(v) AS mu, stddev_pop(v) AS sd FROM wfp WHERE p < 6 OR p >= 58 GROUP BY spike_id),
oo AS (SELECT spike_id, any_value(mu) AS mu, coalesce(min(CASE WHEN abs(v - mu) > greatest({k}::DOUBLE * sd, 1e-9) THEN p END), 0) AS onset,
   coalesce(max(CASE WHEN abs(v - mu) > greatest({k}::DOUBLE * sd, 1e-9) THEN p END), 63) AS offs
   FROM wfp JOIN bs USING (spike_id) GROUP BY spike_id)"""


@query("onset_offset", f"WITH {WF}, {WFP}, {BASE.format(k=2.5)} SELECT spike_id, onset, offs AS \"offset\", {rnd('mu')} AS baseline FROM oo")
def onset_offset(spark, d):
    return S.onset_offset(waveforms(spark, d)).select("spike_id", "onset", "offset", "baseline")


ADP = """pk AS (SELECT spike_id, p AS pp, v AS pv FROM wfp QUALIFY row_number() OVER (PARTITION BY spike_id ORDER BY abs(v) DESC, p) = 1),
adp AS (SELECT spike_id, max(v) - min(v) AS amplitude, CASE WHEN any_value(pv) >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS polarity,
  (coalesce(min(CASE WHEN p > pp AND v * (CASE WHEN pv >= 0 THEN 1 ELSE -1 END) < abs(pv) * 0.5::DOUBLE THEN p END), 63)
   - coalesce(max(CASE WHEN p < pp AND v * (CASE WHEN pv >= 0 THEN 1 ELSE -1 END) < abs(pv) * 0.5::DOUBLE THEN p END), 0)) / 24000.0::DOUBLE * 1000.0::DOUBLE AS duration_ms
  FROM wfp JOIN pk USING (spike_id) GROUP BY spike_id)"""


@query("amp_dur_polarity", f"WITH {WFS}, {WFP}, {ADP} SELECT spike_id, {rnd('amplitude')} AS amplitude, {rnd('duration_ms')} AS duration_ms, polarity FROM adp")
def amp_dur_polarity(spark, d):
    return S.amplitude_duration(waveforms(spark, d, True), FS_WAVE).select("spike_id", "amplitude", "duration_ms", "polarity")


METRICS = """sg AS (SELECT spike_id, p, v, mu, onset, offs FROM wfp JOIN oo USING (spike_id) WHERE p BETWEEN onset AND offs),
am AS (SELECT spike_id, any_value(onset) AS onset, any_value(offs) AS offs, max(v) AS amp_max, min(v) AS amp_min, max(v) - min(v) AS amplitude FROM sg GROUP BY spike_id),
dv AS (SELECT spike_id, CASE WHEN v - mu < 0 THEN -1 ELSE 1 END AS s, lag(CASE WHEN v - mu < 0 THEN -1 ELSE 1 END) OVER w AS ps, abs(v) AS a, lag(abs(v)) OVER w AS pa
  FROM sg WINDOW w AS (PARTITION BY spike_id ORDER BY p)),
ph AS (SELECT spike_id, count(*) FILTER (WHERE s <> ps) + 1 AS phases, coalesce(sum((a + pa) * 0.5), 0) * (1000.0::DOUBLE / 24000.0::DOUBLE) AS area FROM dv GROUP BY spike_id),
st AS (SELECT spike_id, p, v, greatest(amplitude * 0.05::DOUBLE, 1e-9) AS thr, am.offs FROM sg JOIN am USING (spike_id)),
fo AS (SELECT spike_id, p, v AS last, 0 AS dir, 0 AS turns FROM st JOIN am USING (spike_id) WHERE p = am.onset
  UNION ALL
  SELECT st.spike_id, st.p,
    CASE WHEN (dir = 0 AND abs(v - last) > thr) OR (dir > 0 AND (v - last < -thr OR v > last)) OR (dir < 0 AND (v - last > thr OR v < last)) THEN v ELSE last END,
    CASE WHEN dir = 0 AND abs(v - last) > thr THEN CASE WHEN v > last THEN 1 ELSE -1 END
         WHEN (dir > 0 AND v - last < -thr) OR (dir < 0 AND v - last > thr) THEN -dir ELSE dir END,
    turns + CASE WHEN (dir > 0 AND v - last < -thr) OR (dir < 0 AND v - last > thr) THEN 1 ELSE 0 END
  FROM fo JOIN st ON st.spike_id = fo.spike_id AND st.p = fo.p + 1),
tu AS (SELECT spike_id, CAST(max(turns) AS BIGINT) AS turns FROM fo GROUP BY spike_id)"""
MCOLS = f"""onset, offs AS "offset", {rnd('(offs - onset) / 24000.0::DOUBLE * 1000.0::DOUBLE')} AS duration_ms, {rnd('amplitude')} AS amplitude,
  {rnd('amp_max')} AS amp_max, {rnd('amp_min')} AS amp_min, phases, turns, {rnd('area')} AS area"""
MNAMES = ["onset", "offset", "duration_ms", "amplitude", "amp_max", "amp_min", "phases", "turns", "area"]


@query("muap_metrics", f"WITH RECURSIVE {WFS}, {WFP}, {BASE.format(k=2.5)}, {METRICS} SELECT spike_id, {MCOLS} FROM am JOIN ph USING (spike_id) JOIN tu USING (spike_id)")
def muap_metrics(spark, d):
    return S.muap_metrics(waveforms(spark, d, True), FS_WAVE).select("spike_id", *MNAMES)


@query("template_metrics", f"""WITH RECURSIVE {WFS.replace('wf AS', 'raw AS', 1)}, rp AS (SELECT label, CAST(unnest(range(64)) AS BIGINT) AS p, unnest(x) AS v FROM raw),
wfp AS (SELECT label AS spike_id, p, avg(v) AS v FROM rp GROUP BY label, p), ct AS (SELECT label AS spike_id, count(*) AS n FROM raw GROUP BY label),
{BASE.format(k=2.5)}, {METRICS} SELECT spike_id AS label, n, {MCOLS} FROM am JOIN ph USING (spike_id) JOIN tu USING (spike_id) JOIN ct USING (spike_id)""")
def template_metrics(spark, d):
    t = TP.templates(waveforms(spark, d, True), [])
    return S.muap_metrics(t, FS_WAVE, "m").select("label", "n", *MNAMES)


@query("normalize_area", f"""WITH {WFS}, {WFP}, a AS (SELECT spike_id, sum(abs(v)) AS a FROM wfp GROUP BY 1)
SELECT spike_id, p, {rnd('CASE WHEN a > 0 THEN v / a ELSE v END')} AS v FROM wfp JOIN a USING (spike_id)""")
def normalize_area(spark, d):
    return samples(waveforms(spark, d, True).withColumn("x", A.normalize_area("x")), "x")


@query("normalize_peak", f"""WITH {WFS}, {WFP}, a AS (SELECT spike_id, max(abs(v)) AS a FROM wfp GROUP BY 1)
SELECT spike_id, p, {rnd('CASE WHEN a > 0 THEN v / a ELSE v END')} AS v FROM wfp JOIN a USING (spike_id)""")
def normalize_peak(spark, d):
    return samples(waveforms(spark, d, True).withColumn("x", A.normalize_peak("x")), "x")


@query("shift_waveform", f"""WITH {WF}, {WFP}
SELECT a.spike_id, a.p, {rnd('coalesce(b.v, 0)')} AS v FROM wfp a LEFT JOIN wfp b
  ON a.spike_id = b.spike_id AND b.p = a.p - ((a.spike_id % 31) - 15)""")
def shift_waveform(spark, d):
    by = (F.col("spike_id") % 31 - 15).cast("int")
    return samples(waveforms(spark, d).withColumn("y", A.shift("x", by)), "y")


@query("crop", f"WITH {WF}, {WFP} SELECT spike_id, p - 8 AS p, {rnd('v')} AS v FROM wfp WHERE p BETWEEN 8 AND 55")
def crop(spark, d):
    return samples(waveforms(spark, d).withColumn("y", A.crop_center("x", 24)), "y")


@query("time_window", f"""WITH {WF}, {WFP}, t AS (SELECT spike_id, p, v, (p - 32) / 24000.0::DOUBLE * 1000.0::DOUBLE AS t FROM wfp)
SELECT spike_id, row_number() OVER (PARTITION BY spike_id ORDER BY p) - 1 AS p, {rnd('v')} AS v FROM t WHERE t BETWEEN -0.5 AND 0.75""")
def time_window(spark, d):
    rows = waveforms(spark, d).withColumn("t", A.time_axis_ms(F.size("x"), FS_WAVE))
    return samples(rows.withColumn("y", A.window_by_time("x", "t", -0.5, 0.75)), "y")


# --- templates ----------------------------------------------------------------------------------

T_ = f"{WF}, {WFP}, {TPL}, {TPLA}, cn AS (SELECT label, count(*) AS n FROM wf GROUP BY label)"
PL = """pl AS (SELECT a.label AS type_a, b.label AS type_b, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS l2
 FROM tpl a JOIN tpl b ON a.p = b.p AND a.label < b.label GROUP BY ALL)"""


def _tpl(spark, d, scale=False):
    return TP.templates(waveforms(spark, d, scale), [])


def _pairs(spark, d, normalize=False):
    return TP.pair_l2(_tpl(spark, d), [], normalize)


@query("templates", f"WITH {T_} SELECT label, n, p, {rnd('v')} AS v FROM tpl JOIN cn USING (label)")
def templates(spark, d):
    return samples(_tpl(spark, d), "m", ("label", "n"))


@query("pair_l2", f"""WITH {T_}, {PL}, na AS (SELECT label, p, v / sum(abs(v)) OVER (PARTITION BY label) AS v FROM tpl),
pn AS (SELECT a.label AS type_a, b.label AS type_b, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS l2n FROM na a JOIN na b ON a.p = b.p AND a.label < b.label GROUP BY ALL)
SELECT type_a, type_b, x.n AS n_a, y.n AS n_b, {rnd('l2')} AS l2, {rnd('l2n')} AS l2_area FROM pl JOIN pn USING (type_a, type_b)
JOIN cn x ON x.label = type_a JOIN cn y ON y.label = type_b""")
def pair_l2(spark, d):
    area = _pairs(spark, d, True).select("type_a", "type_b", F.col("l2").alias("l2_area"))
    return _pairs(spark, d).join(area, ["type_a", "type_b"])


@query("sorted_l2", f"WITH {T_}, {PL} SELECT type_a, type_b, {rnd('l2')} AS l2, row_number() OVER (ORDER BY l2, type_a, type_b) AS rank FROM pl")
def sorted_l2(spark, d):
    return TP.sorted_l2(_pairs(spark, d), []).select("type_a", "type_b", "l2", "rank")


@query("l2_percentile", f"WITH {T_}, {PL} SELECT {rnd('quantile_cont(l2, 0.2)')} AS threshold FROM pl")
def l2_percentile(spark, d):
    return TP.percentile_threshold(_pairs(spark, d), [], 20)


@query("l2_elbow", f"""WITH {T_}, {PL}, g AS (SELECT l2, lead(l2) OVER (ORDER BY l2) AS nx, row_number() OVER (ORDER BY l2) AS rk FROM pl)
SELECT {rnd('(l2 + nx) / 2')} AS threshold FROM g WHERE nx IS NOT NULL ORDER BY nx - l2 DESC, rk LIMIT 1""")
def l2_elbow(spark, d):
    return TP.elbow_threshold(_pairs(spark, d), [])


FENCE = """fe AS (SELECT count(*) AS n_pairs, min(l2) AS l2_min, median(l2) AS l2_median, mad(l2) AS l2_mad, greatest(median(l2) - {k}::DOUBLE * mad(l2), 0) AS threshold FROM pl)"""


@query("l2_fence", f"WITH {T_}, {PL}, {FENCE.format(k=2.0)} SELECT n_pairs, {rnd('l2_min')} AS l2_min, {rnd('l2_median')} AS l2_median, {rnd('l2_mad')} AS l2_mad, {rnd('threshold')} AS threshold FROM fe")
def l2_fence(spark, d):
    return TP.fence_threshold(_pairs(spark, d), [], 2.0)


CLOSE = "cl AS (SELECT type_a, type_b, l2 FROM pl, fe WHERE threshold > 0 AND l2 <= threshold)"


@query("close_pairs", f"""WITH {T_}, {PL}, {FENCE.format(k=2.0)}, {CLOSE} SELECT type_a, type_b, x.n AS n_a, y.n AS n_b, {rnd('l2')} AS l2
FROM cl JOIN cn x ON x.label = type_a JOIN cn y ON y.label = type_b""")
def close_pairs(spark, d):
    p = _pairs(spark, d)
    return TP.close_pairs(p, TP.fence_threshold(p, [], 2.0), [])


CC = """ed AS (SELECT type_a AS x, type_b AS y FROM cl UNION SELECT type_b, type_a FROM cl),
rc AS (SELECT x AS n, x AS r FROM ed UNION SELECT ed.y, rc.r FROM rc JOIN ed ON ed.x = rc.n),
cp AS (SELECT n AS type, min(r) AS grp FROM rc GROUP BY n)"""


@query("l2_merge", f"""WITH RECURSIVE {T_}, {PL}, {FENCE.format(k=2.0)}, {CLOSE}, {CC}
SELECT spike_id, coalesce(grp, label) AS label FROM wf LEFT JOIN cp ON cp.type = wf.label""")
def l2_merge(spark, d):
    return TP.l2_merge(waveforms(spark, d), [], fence_k=2.0).select("spike_id", "label")


# An explicit threshold would win; here the percentile is the first one given, ahead of elbow and fence.
@query("merge_close", f"""WITH RECURSIVE {T_}, {PL}, fe AS (SELECT quantile_cont(l2, 0.05) AS threshold FROM pl), {CLOSE}, {CC}
SELECT spike_id, coalesce(grp, label) AS label FROM wf LEFT JOIN cp ON cp.type = wf.label""")
def merge_close(spark, d):
    return TP.l2_merge(waveforms(spark, d), [], percentile=5, elbow=True, fence_k=2.0).select("spike_id", "label")


@query("l2_merge_stage", f"""WITH RECURSIVE {WF}, wfp AS (SELECT * FROM (SELECT spike_id, label, CAST(unnest(range(64)) AS BIGINT) AS p, unnest(x) AS v FROM wf) WHERE p BETWEEN 8 AND 55),
t0 AS (SELECT label, p, avg(v) AS v FROM wfp GROUP BY label, p), tpl AS (SELECT label, p, v / sum(abs(v)) OVER (PARTITION BY label) AS v FROM t0),
{PL}, {FENCE.format(k=1.0)}, {CLOSE}, {CC} SELECT spike_id, coalesce(grp, label) AS label FROM wf LEFT JOIN cp ON cp.type = wf.label""")
def l2_merge_stage(spark, d):
    return TP.l2_merge_stage(waveforms(spark, d), [], FS_WAVE, window_ms=1.0, fence_k=1.0).select("spike_id", "label")


SINGLE = """pr AS (SELECT c.label AS type_c, i.label AS type_i, sum(c.v * i.v) AS ci, sum(i.v * i.v) AS ii, sum(c.v * c.v) AS cc
  FROM tpl c JOIN tpl i ON c.p = i.p AND c.label <> i.label GROUP BY ALL),
co AS (SELECT *, CASE WHEN ii > 0 THEN greatest(ci / ii, 0) ELSE 0 END AS coef FROM pr),
rs AS (SELECT type_c, type_i, coef, c.p, c.v - coef * i.v AS r, cc FROM co JOIN tpl c ON c.label = type_c JOIN tpl i ON i.label = type_i AND i.p = c.p),
rf AS (SELECT type_c, type_i, any_value(coef) AS coef, sqrt(sum(r * r)) / (sqrt(any_value(cc)) + 1e-12) AS rf FROM rs GROUP BY ALL),
bs1 AS (SELECT * FROM rf QUALIFY row_number() OVER (PARTITION BY type_c ORDER BY rf, type_i) = 1)"""


@query("best_single_fit", f"WITH {T_}, {SINGLE} SELECT type_c, type_i, {rnd('coef')} AS coef, {rnd('rf')} AS residual_frac FROM bs1")
def best_single_fit(spark, d):
    return TP.best_single_fit(_tpl(spark, d), []).select("type_c", "type_i", "coef", "residual_frac")


SHIFT, IMPROVE, RESID = 6, 0.05, 0.95
SUPER = f"""re AS (SELECT rs.type_c, rs.type_i, rs.p, rs.r FROM rs JOIN bs1 USING (type_c, type_i)),
sh AS (SELECT unnest(range(-{SHIFT}, {SHIFT + 1})) AS s),
cr AS (SELECT re.type_c, re.type_i, j.label AS type_j, s, sum(re.r * j.v) AS c FROM re JOIN sh ON TRUE JOIN tpl j ON j.p = re.p - s AND j.label <> re.type_c AND j.label <> re.type_i GROUP BY ALL),
bsf AS (SELECT type_c, type_i, type_j, s FROM cr QUALIFY row_number() OVER (PARTITION BY type_c, type_j ORDER BY c DESC, s) = 1),
v3 AS (SELECT b.*, c.p, c.v AS vc, i.v AS vi, coalesce(j.v, 0) AS vj FROM bsf b JOIN tpl c ON c.label = b.type_c JOIN tpl i ON i.label = b.type_i AND i.p = c.p
   LEFT JOIN tpl j ON j.label = b.type_j AND j.p = c.p - b.s),
ne AS (SELECT type_c, type_i, type_j, s, sum(vi * vi) AS a, sum(vi * vj) AS b, sum(vj * vj) AS d, sum(vi * vc) AS p, sum(vj * vc) AS q, sum(vc * vc) AS cc FROM v3 GROUP BY ALL),
ck AS (SELECT *, greatest((p * d - q * b) / (a * d - b * b), 0) AS k1, greatest((q * a - p * b) / (a * d - b * b), 0) AS k2 FROM ne),
pf AS (SELECT v3.type_c, v3.type_i, v3.type_j, v3.s, any_value(k1) AS k1, any_value(k2) AS k2,
   sqrt(sum(power(vc - k1 * vi - k2 * vj, 2))) / (sqrt(any_value(cc)) + 1e-12) AS prf FROM v3 JOIN ck USING (type_c, type_i, type_j) GROUP BY ALL),
bp AS (SELECT pf.*, bs1.rf, bs1.rf - prf AS imp FROM pf JOIN bs1 USING (type_c, type_i) QUALIFY row_number() OVER (PARTITION BY type_c ORDER BY prf, type_j) = 1),
sp AS (SELECT * FROM bp WHERE imp >= {IMPROVE!r}::DOUBLE AND prf <= {RESID!r}::DOUBLE)"""


def _super(spark, d):
    return TP.superposition(_tpl(spark, d), [], SHIFT, IMPROVE, RESID)


@query("superposition", f"""WITH {T_}, {SINGLE}, {SUPER} SELECT type_c, type_i, type_j, s AS shift_samples, {rnd('k1')} AS coef_i, {rnd('k2')} AS coef_j,
  {rnd('rf')} AS single_residual_frac, {rnd('prf')} AS pair_residual_frac, {rnd('imp')} AS improvement FROM sp""")
def superposition(spark, d):
    return _super(spark, d)


@query("drop_superposition", f"""WITH {T_}, {SINGLE}, {SUPER}, sv AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS nl FROM (SELECT DISTINCT label FROM wf) WHERE label NOT IN (SELECT type_c FROM sp))
SELECT spike_id, coalesce(nl, -1) AS label FROM wf LEFT JOIN sv USING (label)""")
def drop_superposition(spark, d):
    return TP.drop_superposition(waveforms(spark, d), _super(spark, d), []).select("spike_id", "label")


# Types merged to two: their singular values follow from the two-by-two table of inner products.
@query("effective_rank", f"""WITH {WF}, {WFP}, t AS (SELECT label % 2 AS h, p, avg(v) AS v FROM wfp GROUP BY ALL), c AS (SELECT label % 2 AS h, count(*) AS n FROM wf GROUP BY ALL),
g AS (SELECT sum(CASE WHEN h = 0 THEN v * v * n END) AS a, sum(CASE WHEN h = 1 THEN v * v * n END) AS b FROM t JOIN c USING (h)),
x AS (SELECT sum(t0.v * t1.v) * sqrt((SELECT n FROM c WHERE h = 0) * (SELECT n FROM c WHERE h = 1)) AS ab FROM t t0 JOIN t t1 ON t0.p = t1.p AND t0.h = 0 AND t1.h = 1),
s AS (SELECT a + b AS energy, sqrt((a + b + sqrt((a - b) * (a - b) + 4 * ab * ab)) / 2) AS s0, sqrt((a + b - sqrt((a - b) * (a - b) + 4 * ab * ab)) / 2) AS s1,
  2.4::DOUBLE / (sqrt(2) + sqrt(64)) * (sqrt(2) + sqrt(64)) AS ceiling FROM g, x)
SELECT 2::BIGINT AS n_types, CAST((s0 > ceiling)::INT + (s1 > ceiling)::INT AS BIGINT) AS n_significant, {rnd('ceiling')} AS noise_ceiling, {rnd('energy')} AS energy,
  {rnd('s0')} AS s0, {rnd('s1')} AS s1 FROM s""")
def effective_rank(spark, d):
    two = TP.templates(waveforms(spark, d).withColumn("label", F.col("label") % 2), [])
    sv = F.col("singular_values")
    return TP.effective_rank(two, [], 2.4 / (2 ** 0.5 + 8)).select("n_types", "n_significant", "noise_ceiling", "energy", sv[0].alias("s0"), sv[1].alias("s1"))


# --- features -----------------------------------------------------------------------------------

@query("build_features", f"""WITH {WFS}, {WFP}, {_terms(2)}, {ADP}, f AS (SELECT spike_id, c0, c1, amplitude AS a, duration_ms AS du, polarity AS po FROM ct JOIN adp USING (spike_id)),
s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in ('c0', 'c1', 'a', 'du', 'po'))} FROM f)
SELECT spike_id, {', '.join(f'{rnd(f"CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0 END * {w}")} AS f{k}' for k, (c, w) in enumerate([('c0', 1.0), ('c1', 1.0), ('a', 0.5), ('du', 0.5), ('po', 2.0)]))} FROM f, s""")
def build_features(spark, d):
    rows = S.amplitude_duration(waveforms(spark, d, True), FS_WAVE).withColumn("shape", A.dct_low("x", 2))
    out = FE.assemble(rows, 2, 0.5, 2.0)
    return out.select("spike_id", *[F.col("features")[k].alias(f"f{k}") for k in range(5)])


# The two halves of a waveform, summed: axes of two variables have a closed form, signs included.
AXES = f"""{WFS}, hv AS (SELECT spike_id, list_sum(x[1:32]) AS u, list_sum(x[33:64]) AS w FROM wf),
mo AS (SELECT avg(u) AS mu, avg(w) AS mw, var_samp(u) AS a, var_samp(w) AS c, covar_samp(u, w) AS b FROM hv),
la AS (SELECT *, (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) - a AS y FROM mo),
ax AS (SELECT mu, mw, b / sqrt(b * b + y * y) AS vx, y / sqrt(b * b + y * y) AS vy FROM la),
sg AS (SELECT *, CASE WHEN (CASE WHEN abs(vx) >= abs(vy) THEN vx ELSE vy END) < 0 THEN -1 ELSE 1 END AS s1,
  CASE WHEN (CASE WHEN abs(vy) >= abs(vx) THEN -vy ELSE vx END) < 0 THEN -1 ELSE 1 END AS s2 FROM ax),
pc AS (SELECT spike_id, ((u - mu) * vx + (w - mw) * vy) * s1 AS p0, ((u - mu) * -vy + (w - mw) * vx) * s2 AS p1 FROM hv, sg)"""


def _halves(spark, d):
    x = F.array(A.total(F.slice("x", 1, 32)), A.total(F.slice("x", 33, 32)))
    return waveforms(spark, d, True).withColumn("x", x)


@query("pca_scores", f"WITH {AXES} SELECT spike_id, {rnd('p0')} AS p0, {rnd('p1')} AS p1 FROM pc")
def pca_scores(spark, d):
    return FE.pca_scores(_halves(spark, d), 2).select("spike_id", F.col("shape")[0].alias("p0"), F.col("shape")[1].alias("p1"))


@query("pca_energy", f"""WITH {WFS}, {WFP}, m AS (SELECT p, avg(v) AS m FROM wfp GROUP BY p)
SELECT spike_id, {rnd('sum((v - m) * (v - m))')} AS energy FROM wfp JOIN m USING (p) GROUP BY spike_id""")
def pca_energy(spark, d):
    """All components: a rotation of the centred waveform, so its energy is preserved."""
    return FE.pca_scores(waveforms(spark, d, True), N).select("spike_id", A.sum_sq("shape").alias("energy"))


@query("pca_var90", f"WITH {AXES} SELECT spike_id, 2::BIGINT AS n_pc, unnest([0::BIGINT, 1]) AS pc, unnest([{rnd('p0')}, {rnd('p1')}]) AS score FROM pc")
def pca_var90(spark, d):
    scores, n_pc = FE.pca_by_variance(_halves(spark, d))
    return scores.select("spike_id", F.lit(n_pc).alias("n_pc"), F.posexplode("shape").alias("pc", "score"))


@query("pca_var90_full")
def pca_var90_full(spark, d):
    scores, n_pc = FE.pca_by_variance(waveforms(spark, d, True))
    return scores.select("spike_id", F.lit(n_pc).alias("n_pc"), F.posexplode("shape").alias("pc", "score"))


def _k2(n: str, s: str, k: str) -> list[str]:
    """The K^2 statistic as a chain of SQL columns."""
    return [
        f"SELECT *, CAST({n} AS DOUBLE) AS n, {s} AS g1, {k} AS g2 FROM mo",
        """SELECT *, CASE WHEN g1 = 0 THEN 1 ELSE g1 * sqrt(((n + 1) * (n + 3)) / (6 * (n - 2))) END AS y,
           sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
           (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
           6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM k0""",
        """SELECT *, y / sqrt(2 / (w2 - 1)) AS ya, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM k1""",
        """SELECT *, ln(ya + sqrt(ya * ya + 1)) / sqrt(0.5 * ln(w2)) AS zs, 1 + x * sqrt(2 / (aa - 4)) AS den FROM k2""",
        """SELECT *, (1 - 2 / (9 * aa) - sign(den) * power((1 - 2 / aa) / abs(den), 1.0::DOUBLE / 3.0::DOUBLE)) / sqrt(2 / (9 * aa)) AS zk FROM k3""",
    ]


def _dwt_sql(length: int, level: int) -> str:
    """Multi-level DWT as SQL: one common table per level, symmetric padding by index reflection."""
    lo = FE.SYMLETS["sym2"]
    hi = [v * (-1 if k % 2 == 0 else 1) for k, v in enumerate(lo[::-1])]
    parts, name, n, bands = ["tap AS (SELECT unnest(range(4)) AS j, unnest([%s]) AS lo, unnest([%s]) AS hi)" % (
        ", ".join(f"{v!r}::DOUBLE" for v in lo), ", ".join(f"{v!r}::DOUBLE" for v in hi))], "wfp", length, []
    for lv in range(1, level + 1):
        half = (n + 3) // 2
        pos = "(2 * k.k + 1 - tap.j)"
        src = f"CASE WHEN {pos} < 0 THEN -1 - {pos} WHEN {pos} >= {n} THEN {2 * n - 1} - {pos} ELSE {pos} END"
        parts.append(f"b{lv} AS (SELECT a.spike_id, k.k AS p, sum(a.v * tap.lo) AS v, sum(a.v * tap.hi) AS h "
                     f"FROM (SELECT unnest(range({half})) AS k) k JOIN tap ON TRUE JOIN {name} a ON a.p = {src} GROUP BY ALL)")
        bands.append((lv, half))
        name, n = f"b{lv}", half
    pieces, off = [f"SELECT spike_id, p AS j, v FROM b{level}"], n
    for lv, half in reversed(bands):
        pieces.append(f"SELECT spike_id, p + {off} AS j, h AS v FROM b{lv}")
        off += half
    return ", ".join(parts) + ", cf AS (" + " UNION ALL ".join(pieces) + ")"


WAVELET = f"""{WFS}, {WFP}, {_dwt_sql(N, 4)},
lm AS (SELECT j, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM cf GROUP BY j),
wz AS (SELECT spike_id, j, greatest(least(v, hi), lo) AS v FROM cf JOIN lm USING (j)),
m1 AS (SELECT j, count(*) AS c, avg(v) AS mu, max(v) - min(v) AS rg FROM wz GROUP BY j),
mo AS (SELECT j, any_value(c) AS c, any_value(rg) AS rg, avg(power(v - mu, 2)) AS v2, avg(power(v - mu, 3)) AS v3, avg(power(v - mu, 4)) AS v4 FROM wz JOIN m1 USING (j) GROUP BY j),
{', '.join(f'k{i} AS ({q})' for i, q in enumerate(_k2('c', 'v3 / power(v2, 1.5)', 'v4 / (v2 * v2) - 3')))},
sc AS (SELECT j, CASE WHEN rg = 0 THEN 0 ELSE zs * zs + zk * zk END AS k2 FROM k4)"""


def _coefs(spark, d):
    return FE.wavelet_coefficients(waveforms(spark, d, True), "sym2")


@query("wavelet_k2", f"WITH {WAVELET} SELECT CAST(j AS BIGINT) AS j, {rnd('k2', 5)} AS k2 FROM sc", digits=5)
def wavelet_k2(spark, d):
    return FE.discriminative_coefficients(_coefs(spark, d), "spike_id", 4)[0]


@query("wavelet_topk", f"""WITH {WAVELET}, tp AS (SELECT j, row_number() OVER (ORDER BY k2 DESC, j DESC) - 1 AS rank FROM sc ORDER BY k2 DESC, j DESC LIMIT 4)
SELECT spike_id, CAST(wz.j AS BIGINT) AS j, rank, {rnd('v')} AS v FROM wz JOIN tp USING (j)""")
def wavelet_topk(spark, d):
    return FE.discriminative_coefficients(_coefs(spark, d), "spike_id", 4)[1]
