"""Queries over sampled traces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dischargelab.functions import arrays as A
from dischargelab.functions.filters import design
from dischargelab.operators import packed as PK
from dischargelab.operators import shapes as S
from dischargelab.operators import signal as G
from dischargelab.operators import templates as TP
from dischargelab.plans.fixtures import FS_TRACE, FS_WAVE, TRACE, trace, waveforms
from dischargelab.plans.q_trains import GREEDY
from dischargelab.plans.registry import query, rnd
from dischargelab.session import ensure_checkpoint_dir, materialize
from dischargelab.sources.traces import read_written_trace, write_text_trace

RUN = ["run_id"]
WIDTH, DIST, KMAD = 6, 9, 1.2
HALF, BASE = 8, 12

ENV = f"""{TRACE}, ev AS (SELECT run_id, i, sum(v) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6 AS v FROM tr),
th AS (SELECT run_id, median(v) / 0.6745::DOUBLE AS sigma, median(v) / 0.6745::DOUBLE * {KMAD!r}::DOUBLE AS threshold FROM ev GROUP BY run_id)"""
# Runs of equal rounded values are one plateau; the value itself is kept from the row.
PEAKS = f"""ch AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY run_id ORDER BY i) THEN 1 ELSE 0 END AS nw FROM {{src}}),
pg AS (SELECT *, sum(nw) OVER (PARTITION BY run_id ORDER BY i) AS g FROM ch),
pt AS (SELECT run_id, g, min(i) AS a, max(i) AS b, any_value(v) AS v FROM pg GROUP BY run_id, g),
nb AS (SELECT *, lag(v) OVER (PARTITION BY run_id ORDER BY g) AS pv, lead(v) OVER (PARTITION BY run_id ORDER BY g) AS nv FROM pt),
lm AS (SELECT run_id, (a + b) // 2 AS i, v FROM nb WHERE v > pv AND v > nv)"""
THIN = GREEDY.format(key="run_id", rkey="r.run_id", src="(SELECT run_id, -i AS t, v AS amp, i AS spike_id FROM hi)",
                     tmin=f"{DIST}", name="gr", join="r.run_id = g.run_id")
EP = f"""{ENV}, {PEAKS.format(src='ev')}, hi AS (SELECT lm.* FROM lm JOIN th USING (run_id) WHERE v >= threshold), {THIN},
ep AS (SELECT run_id, spike_id AS i FROM gr WHERE keep)"""
SNAP = f"""sn AS (SELECT DISTINCT run_id, s AS i FROM (
  SELECT ep.run_id, ep.i, tr.i AS s FROM ep JOIN tr ON tr.run_id = ep.run_id AND tr.i BETWEEN ep.i - {WIDTH} AND ep.i + {WIDTH}
  QUALIFY row_number() OVER (PARTITION BY ep.run_id, ep.i ORDER BY tr.v DESC, tr.i) = 1))"""


def _env(tr):
    return G.envelope(G.rectify(tr), RUN, WIDTH)


def _peaks(tr):
    """Read twice, for the threshold and for the peaks, so the envelope is kept."""
    env = materialize(_env(tr))
    return G.envelope_peaks(env, G.mad_threshold(env, RUN, KMAD), RUN, DIST)


def _snapped(tr):
    return G.snap(_peaks(tr), G.rectify(tr), RUN, WIDTH)


def _cut(tr):
    return G.extract_waveforms(tr, _snapped(tr), RUN, HALF, BASE)


def _kept(spark, d):
    return materialize(trace(spark, d))


@query("trace_index", f"WITH {TRACE} SELECT run_id, i, v FROM tr")
def trace_index(spark, d):
    return trace(spark, d)


@query("trace_slice", f"WITH {TRACE} SELECT run_id, i, v FROM tr WHERE i >= 50 AND i < 800")
def trace_slice(spark, d):
    start, duration = 0.05, 0.75
    lo = round(start * FS_TRACE)
    return trace(spark, d).where((F.col("i") >= lo) & (F.col("i") < lo + round(duration * FS_TRACE)))


@query("rectify", f"WITH {TRACE} SELECT run_id, i, {rnd('abs(v - 50)')} AS v FROM tr")
def rectify(spark, d):
    return G.rectify(trace(spark, d).withColumn("v", F.col("v") - 50))


@query("envelope", f"WITH {ENV} SELECT run_id, i, {rnd('v')} AS v FROM ev")
def envelope(spark, d):
    return _env(trace(spark, d))


@query("mad_threshold", f"WITH {ENV}, q AS (SELECT run_id, median(v) / 0.6745::DOUBLE AS s FROM ev WHERE i < 300 GROUP BY run_id) "
       f"SELECT run_id, {rnd('sigma')} AS sigma, {rnd('threshold')} AS threshold, {rnd('s')} AS quiet_sigma FROM th JOIN q USING (run_id)")
def mad_threshold(spark, d):
    env = materialize(_env(trace(spark, d)))
    quiet = G.mad_threshold(env, RUN, KMAD, 300).select("run_id", F.col("sigma").alias("quiet_sigma"))
    return G.mad_threshold(env, RUN, KMAD).join(quiet, "run_id")


@query("local_maxima", f"WITH {TRACE}, {PEAKS.format(src='tr')} SELECT run_id, i, v FROM lm")
def local_maxima(spark, d):
    return G.local_maxima(trace(spark, d), RUN)


@query("envelope_peaks", f"WITH RECURSIVE {EP} SELECT run_id, i FROM ep")
def envelope_peaks(spark, d):
    return _peaks(_kept(spark, d)).select("run_id", "i")


@query("peak_snap", f"WITH RECURSIVE {EP}, {SNAP} SELECT run_id, i FROM sn")
def peak_snap(spark, d):
    return _snapped(_kept(spark, d))


CUT = f"""nn AS (SELECT run_id, count(*) AS n FROM tr GROUP BY run_id),
ok AS (SELECT sn.run_id, sn.i FROM sn JOIN nn USING (run_id) WHERE i - {BASE} >= 0 AND i + {BASE} < n),
bl AS (SELECT ok.run_id, ok.i, avg(tr.v) AS m FROM ok JOIN tr ON tr.run_id = ok.run_id AND tr.i >= ok.i - {BASE} AND tr.i < ok.i + {BASE} GROUP BY ALL),
wv AS (SELECT bl.run_id, bl.i, tr.i - bl.i + {HALF} AS p, tr.v - m AS v FROM bl JOIN tr ON tr.run_id = bl.run_id AND tr.i >= bl.i - {HALF} AND tr.i < bl.i + {HALF})"""


@query("extract_waveforms", f"WITH RECURSIVE {EP}, {SNAP}, {CUT} SELECT run_id, i, p, {rnd('v')} AS v FROM wv")
def extract_waveforms(spark, d):
    return _cut(_kept(spark, d)).select("run_id", "i", F.posexplode("x").alias("p", "v"))


# Spike times on the trace clock: each event's own index is its sample, in seconds. Square roots of the
# values are used, since two-decimal values average to decimals that end exactly on a rounding tie.
REAV = """att AS (SELECT run_id, i AS c, i % 4 AS label FROM tr JOIN (SELECT run_id, count(*) AS n FROM tr GROUP BY run_id) USING (run_id) WHERE i - 8 >= 0 AND i + 8 < n),
b AS (SELECT att.run_id, c, label, avg(sqrt(v)) AS m FROM att JOIN tr ON tr.run_id = att.run_id AND tr.i >= c - 8 AND tr.i < c + 8 GROUP BY ALL),
w AS (SELECT b.run_id, b.label, c, tr.i - c + 8 AS p, sqrt(v) - m AS v FROM b JOIN tr ON tr.run_id = b.run_id AND tr.i >= c - 8 AND tr.i < c + 8)"""


@query("reaverage", f"WITH {TRACE}, {REAV} SELECT run_id, label, count(*) AS n, p, {rnd('avg(v)', 9)} AS v FROM w GROUP BY run_id, label, p", digits=9)
def reaverage(spark, d):
    tr = _kept(spark, d).withColumn("v", F.sqrt("v"))
    at = tr.select("run_id", (F.col("i") / FS_TRACE).alias("t"), (F.col("i") % 4).alias("label"))
    out = G.reaverage(tr, at, RUN, FS_TRACE, 8.0)
    return out.select("run_id", "label", "n", F.posexplode("m").alias("p", "v"))


WIDE = f"""wd AS (SELECT bl.run_id, bl.i, tr.i - bl.i + {BASE} AS p, tr.v - m AS v FROM bl JOIN tr ON tr.run_id = bl.run_id AND tr.i >= bl.i - {BASE} AND tr.i < bl.i + {BASE})"""


@query("wide_recut", f"WITH RECURSIVE {EP}, {SNAP}, {CUT}, {WIDE} SELECT run_id, i, p, {rnd('v')} AS v FROM wd")
def wide_recut(spark, d):
    tr = _kept(spark, d)
    clustered = materialize(_cut(tr).select("run_id", "i"))
    return G.wide_recut(tr, clustered, RUN, BASE, BASE).select("run_id", "i", F.posexplode("x").alias("p", "v"))


@query("run_consistency", """SELECT count(DISTINCT CASE WHEN label < 0 THEN 0 ELSE 24000 END) AS n_rates, count(DISTINCT len(embedding)) AS n_lengths,
  count(*) AS n_spikes FROM embeddings""")
def run_consistency(spark, d):
    return G.check_runs(waveforms(spark, d).withColumn("fs", F.lit(FS_WAVE)), [])


def _sections(kind: str, low: float, high: float | None, fs: float) -> list[tuple[list[float], list[float]]]:
    """The filter as second-order sections (b, a): conjugate poles in pairs, with a zero at 1 and, for a band, one at -1."""
    _, p, gain, _, _ = design(kind, low, high, fs)
    pairs = [(-2 * q.real, abs(q) ** 2) for q in p if q.imag > 0]
    b = [1.0, -2.0, 1.0] if kind == "highpass" else [1.0, 0.0, -1.0]
    g = gain ** (1 / len(pairs))
    return [([g * x for x in b], [1.0, *a]) for a in pairs]


def filter_sql(src: str, out: str, kind: str, low: float, high: float | None) -> str:
    """Common tables that filter ``src`` (run_id, i, v) forward and backward into ``out``, sample by sample."""
    sections, pad = _sections(kind, low, high, FS_TRACE), design(kind, low, high, FS_TRACE)[3]
    names = [f"s{k}{j}" for k in range(len(sections)) for j in (1, 2)]

    def num(v):
        return f"({float(v)!r})::DOUBLE"

    def one_way(source: str, name: str) -> str:
        """Section by section in transposed form; the states begin as if the first sample had always been there."""
        y, gain, rest, step = "x", 1.0, [], []
        for k, (b, a) in enumerate(sections):
            into, gain = gain, gain * sum(b) / sum(a)
            s2 = b[2] * into - a[2] * gain
            rest += [f"{num(b[1] * into - a[1] * gain + s2)} * x", f"{num(s2)} * x"]
            step.append(f"{num(b[0])} * {y} + s{k}1 AS y{k}")
            y = f"y{k}"
        new, y = [], "x"
        for k, (b, a) in enumerate(sections):
            new += [f"{num(b[1])} * {y} - {num(a[1])} * y{k} + s{k}2", f"{num(b[2])} * {y} - {num(a[2])} * y{k}"]
            y = f"y{k}"
        return f"""{name}(run_id, k, y, {', '.join(names)}) AS (
  SELECT run_id, CAST(-1 AS BIGINT), CAST(NULL AS DOUBLE), {', '.join(rest)} FROM {source} WHERE k = 0
  UNION ALL
  SELECT run_id, k, {y}, {', '.join(new)} FROM (
    SELECT f.run_id, e.k, e.x, {', '.join('f.' + n for n in names)}, {', '.join(step)} FROM {name} f JOIN {source} e ON e.run_id = f.run_id AND e.k = f.k + 1))"""

    return f"""{out}n AS (SELECT run_id, count(*) AS n FROM {src} GROUP BY run_id),
{out}e AS MATERIALIZED (
  SELECT run_id, i + {pad} AS k, CAST(v AS DOUBLE) AS x FROM {src}
  UNION ALL SELECT s.run_id, {pad} - s.i, 2 * z.v - s.v FROM {src} s JOIN {src} z ON z.run_id = s.run_id AND z.i = 0 WHERE s.i BETWEEN 1 AND {pad}
  UNION ALL SELECT s.run_id, {pad} + 2 * (n - 1) - s.i, 2 * z.v - s.v FROM {src} s JOIN {out}n USING (run_id) JOIN {src} z ON z.run_id = s.run_id AND z.i = n - 1
    WHERE s.i BETWEEN n - 1 - {pad} AND n - 2),
{one_way(out + 'e', out + 'f')},
{out}r AS MATERIALIZED (SELECT run_id, n + {2 * pad} - 1 - k AS k, y AS x FROM {out}f JOIN {out}n USING (run_id) WHERE k >= 0),
{one_way(out + 'r', out + 'b')},
{out} AS MATERIALIZED (SELECT run_id, n + {pad} - 1 - k AS i, y AS v FROM {out}b JOIN {out}n USING (run_id) WHERE k BETWEEN {pad} AND n + {pad} - 1)"""


@query("bandpass", f"WITH RECURSIVE {TRACE}, {filter_sql('tr', 'fl', 'bandpass', 20.0, 200.0)} SELECT run_id, i, {rnd('v')} AS v FROM fl")
def bandpass(spark, d):
    return G.bandpass(trace(spark, d), RUN, FS_TRACE, 20.0, 200.0)


@query("highpass", f"WITH RECURSIVE {TRACE}, {filter_sql('tr', 'fl', 'highpass', 100.0, None)} SELECT run_id, i, {rnd('v')} AS v FROM fl")
def highpass(spark, d):
    return G.highpass(trace(spark, d), RUN, FS_TRACE, 100.0)


@query("highpass_blocks", f"WITH RECURSIVE {TRACE}, {filter_sql('tr', 'fl', 'highpass', 2.0, None)} SELECT run_id, i, {rnd('v')} AS v FROM fl")
def highpass_blocks(spark, d):
    """A cut-off so low that the filter remembers several blocks."""
    return G.highpass(trace(spark, d), RUN, FS_TRACE, 2.0, 128)


# The chain of the signal operators on the filtered trace.
DETECT = f"""{TRACE}, {filter_sql('tr', 'fl', 'highpass', 100.0, None)},
ev AS (SELECT run_id, i, sum(abs(v)) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6 AS v FROM fl),
th AS (SELECT run_id, median(v) / 0.6745::DOUBLE AS sigma, median(v) / 0.6745::DOUBLE * {KMAD!r}::DOUBLE AS threshold FROM ev GROUP BY run_id),
{PEAKS.format(src='ev')}, hi AS (SELECT lm.* FROM lm JOIN th USING (run_id) WHERE v >= threshold), {THIN},
ep AS (SELECT run_id, spike_id AS i FROM gr WHERE keep), fa AS (SELECT run_id, i, abs(v) AS v FROM fl),
{SNAP.replace('JOIN tr ON tr.run_id', 'JOIN fa tr ON tr.run_id')}"""


@query("detect", f"WITH RECURSIVE {DETECT} SELECT run_id, i, {rnd('sigma')} AS sigma, {rnd('threshold')} AS threshold FROM sn JOIN th USING (run_id)")
def detect(spark, d):
    found = G.detect(_kept(spark, d), RUN, FS_TRACE, 100.0, KMAD, float(DIST), float(WIDTH))
    return found["peaks"].join(found["thresholds"], "run_id")


@query("detect_cut", f"""WITH RECURSIVE {DETECT}, {filter_sql('tr', 'fb', 'bandpass', 20.0, 400.0)},
{CUT.replace('JOIN tr ON tr.run_id', 'JOIN fb tr ON tr.run_id')} SELECT run_id, i, p, {rnd('v')} AS v FROM wv""")
def detect_cut(spark, d):
    """Waveforms of the band-passed trace at all detections, from packed blocks."""
    found = G.detect(_kept(spark, d), RUN, FS_TRACE, 100.0, KMAD, float(DIST), float(WIDTH), size=512)
    measured = PK.zero_phase_blocks(found["packed"], RUN, "bandpass", 20.0, 400.0, FS_TRACE)
    return G.cut_blocks(measured, found["peaks"], RUN, HALF, BASE, size=512).select("run_id", "i", F.posexplode("x").alias("p", "v"))


@query("block_quantiles", f"WITH {TRACE} SELECT run_id, {rnd('quantile_cont(v, 0.05)')} AS low, {rnd('median(v)')} AS mid, "
       f"{rnd('quantile_cont(v, 0.999)')} AS high FROM tr GROUP BY run_id")
def block_quantiles(spark, d):
    return PK.block_quantiles(materialize(PK.pack(trace(spark, d), RUN)), RUN, {"low": 0.05, "mid": 0.5, "high": 0.999})


@query("hf_power")
def hf_power(spark, d):
    return G.hf_power(waveforms(spark, d), FS_WAVE).select("spike_id", F.posexplode("hf_power").alias("p", "power"))


@query("center_select")
def center_select(spark, d):
    t = TP.templates(waveforms(spark, d), []).withColumnRenamed("m", "x")
    t = t.withColumn("t_ms", A.time_axis_ms(F.size("x"), FS_WAVE))
    return G.center_select(t, FS_WAVE).select("label", "n", "peak_t_ms", "centered", "enough_trials", "survived")


@query("scalogram")
def scalogram(spark, d):
    t = TP.templates(waveforms(spark, d), []).withColumnRenamed("m", "x")
    return G.scalogram(t, ["label"], FS_WAVE)


@query("type_table", f"""WITH {TRACE}, {REAV}, m AS (SELECT run_id, label, count(*) AS n, p, avg(v) AS v FROM w GROUP BY run_id, label, p),
bs AS (SELECT run_id, label, avg(v) AS mu, stddev_pop(v) AS sd FROM m WHERE p < 1 OR p >= 15 GROUP BY ALL),
oo AS (SELECT m.run_id, m.label, coalesce(min(CASE WHEN abs(v - mu) > greatest(2.5::DOUBLE * sd, 1e-9) THEN p END), 0) AS a,
  coalesce(max(CASE WHEN abs(v - mu) > greatest(2.5::DOUBLE * sd, 1e-9) THEN p END), 15) AS b FROM m JOIN bs USING (run_id, label) GROUP BY ALL)
SELECT run_id, label, any_value(n) AS n, {rnd('max(v) - min(v)')} AS amplitude, {rnd('any_value(b - a) / 1000.0::DOUBLE * 1000.0::DOUBLE')} AS duration_ms
FROM m JOIN oo USING (run_id, label) WHERE p BETWEEN a AND b GROUP BY run_id, label""")
def type_table(spark, d):
    tr = _kept(spark, d).withColumn("v", F.sqrt("v"))
    at = tr.select("run_id", (F.col("i") / FS_TRACE).alias("t"), (F.col("i") % 4).alias("label"))
    out = S.muap_metrics(G.reaverage(tr, at, RUN, FS_TRACE, 8.0), FS_TRACE, "m")
    return out.select("run_id", "label", "n", "amplitude", "duration_ms")


@query("trace_roundtrip", f"WITH {TRACE} SELECT run_id, i, round_even(v / 7.0::DOUBLE, 6) + 0 AS v FROM tr")
def trace_roundtrip(spark, d):
    return trace(spark, d).withColumn("v", F.bround(F.col("v") / 7.0, 6))


@query("text_roundtrip", f"WITH {TRACE} SELECT run_id, i, round_even(v / 7.0::DOUBLE, 6) + 0 AS v FROM tr")
def text_roundtrip(spark, d):
    """Through the writer and the reader of text recordings, in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/text-{uuid.uuid4().hex}"
    write_text_trace(trace(spark, d).withColumn("v", F.col("v") / 7.0), 1000.0, path)
    return read_written_trace(spark, path)
