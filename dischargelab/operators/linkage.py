"""Latency linkage between types, type grouping, and scoring against known discharges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dischargelab.operators.ordered import neighbours, quantiles
from dischargelab.operators.trains import min_isi
from dischargelab.session import attach, group_bound, groups_bounded, largest_group, materialize, shuffle_width

SLOT_ROWS = 50_000  # spikes in a stretch of the latency sweep
SMALL_GRAPH = 10_000


def nearest_latencies(spikes: DataFrame, keys: list[str], max_latency: float, label: str = "label",
                      t: str = "t", sid: str = "spike_id", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(keys, type_i, type_j, latency): of every spike and other type, the nearest spike if it is within ``max_latency``.

    A task sweeps one stretch of one run with a halo of ``max_latency`` on either side; stretches are as wide as
    ``slot_rows`` spikes at the run's mean rate. Only matches become rows. A stretch denser than the group bound is shared by
    several tasks, each with a part of its spikes and the distinct times around them.
    """
    base = spikes.select(*keys, label, t, sid).where(F.col(label).isNotNull() & F.col(t).isNotNull())
    rate = base.groupBy(*keys).agg(((F.max(t) - F.min(t)) * slot_rows / F.count(F.lit(1))).alias("_w"))
    width = F.greatest(F.col("_w"), F.lit(float(max_latency)))
    base = attach(base, rate.select(*keys, F.when(width > 0, width).otherwise(1.0).alias("_w")), keys)
    slot, reach = F.floor(F.col(t) / F.col("_w")), max_latency * (1 + 1e-6)
    near = F.sequence(F.floor((F.col(t) - reach) / F.col("_w")), F.floor((F.col(t) + reach) / F.col("_w")))
    bound = group_bound(spikes.sparkSession)
    parts = -(-largest_group(base.withColumn("_s", slot), keys + ["_s"]) // bound)
    cols = [*keys, label, t, "_s", "_p", "_own"]
    if parts <= 1:
        rows = base.withColumn("_s", F.explode(near)).withColumn("_p", F.lit(0)).withColumn("_own", F.col("_s") == slot).select(*cols)
    else:
        own = base.withColumn("_s", slot).withColumn("_p", F.pmod(F.xxhash64(sid), F.lit(parts)).cast("int")).withColumn("_own", F.lit(True))
        around = base.select(*keys, label, t, "_w").distinct().withColumn("_s", F.explode(near)).withColumn(
            "_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_own", F.lit(False))
        rows = own.select(*cols).unionByName(around.select(*cols))
    schema = T.StructType([spikes.schema[k] for k in keys] + [
        T.StructField("type_i", spikes.schema[label].dataType), T.StructField("type_j", spikes.schema[label].dataType),
        T.StructField("latency", T.DoubleType())])

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["_own"]]
        ts, of = own[t].to_numpy(), own[label].to_numpy()
        found = []
        for j, times in pdf.groupby(label)[t]:
            times = np.unique(times.to_numpy())
            k = np.searchsorted(times, ts)
            back = np.where(k > 0, ts - times[np.maximum(k - 1, 0)], np.inf)
            ahead = np.where(k < len(times), times[np.minimum(k, len(times) - 1)] - ts, np.inf)
            hit = np.flatnonzero((of != j) & (np.minimum(back, ahead) <= max_latency))
            lat = np.where(ahead < back, ahead, -back)[hit]
            found.append(pd.DataFrame({"type_i": of[hit], "type_j": np.full(len(hit), j, of.dtype), "latency": lat}))
        out = pd.concat(found, ignore_index=True)
        for n, key in enumerate(keys):
            out.insert(n, key, np.repeat(pdf[key].to_numpy()[:1], len(out)))  # keeps its type where nothing matches
        return out

    rows = rows.repartition(shuffle_width(spikes.sparkSession), *keys, "_s", "_p")  # small rows, long work: not to be coalesced
    return rows.groupBy(*keys, "_s", "_p").applyInPandas(sweep, schema)


def pair_latency(spikes: DataFrame, keys: list[str], max_latency: float, label: str = "label",
                 t: str = "t", sid: str = "spike_id") -> DataFrame:
    """For each ordered type pair, how often and how regularly type j fires next to type i.

    Types are paired through one row per (run, type); spikes only by the sweep of ``nearest_latencies``. Latencies are in the
    unit of ``t`` times 1000.
    """
    if not keys:
        return pair_latency(spikes.withColumn("_one", F.lit(0)), ["_one"], max_latency, label, t, sid).drop("_one")
    size = materialize(spikes.where(F.col(t).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_i")))
    pair = keys + ["type_i", "type_j"]
    pairs = size.withColumnRenamed(label, "type_i").join(size.select(*keys, F.col(label).alias("type_j")), keys).where("type_i <> type_j")
    hits = materialize(nearest_latencies(spikes, keys, max_latency, label, t, sid))
    agg = [F.count("latency").alias("n_matched"), (F.avg("latency") * 1000).alias("latency_mean_ms"),
           (F.stddev_pop("latency") * 1000).alias("latency_std_ms")]
    bounded = groups_bounded(hits, pair)
    if bounded:
        stats = hits.groupBy(*pair).agg(*agg, F.percentile("latency", F.lit(0.5)).alias("_md"))
    else:
        stats = hits.groupBy(*pair).agg(*agg).join(quantiles(hits, pair, "latency", {"_md": 0.5}, bounded=False), pair, "left")
    out = pairs.join(stats, pair, "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0).cast("long")))
    return out.withColumn("co_occurrence", F.col("n_matched") / F.col("n_i")).withColumn("latency_median_ms", F.col("_md") * 1000).drop("_md")


def linked_pairs(stats: DataFrame, keys: list[str], min_co: float, max_std_ms: float,
                 symmetric: bool = False) -> DataFrame:
    """Unordered pairs that fire together at a near-fixed offset."""
    fwd = stats.where("type_i < type_j").select(
        *keys, F.col("type_i").alias("type_a"), F.col("type_j").alias("type_b"), F.col("n_i").alias("n_a"),
        F.col("co_occurrence").alias("co_ab"), "latency_mean_ms", "latency_std_ms")
    rev = stats.where("type_i > type_j").select(
        *keys, F.col("type_j").alias("type_a"), F.col("type_i").alias("type_b"), F.col("n_i").alias("n_b"),
        F.col("co_occurrence").alias("co_ba"))
    co = (F.least if symmetric else F.greatest)("co_ab", "co_ba")
    return (
        fwd.join(rev, keys + ["type_a", "type_b"])
        .where((co >= min_co) & (F.col("latency_std_ms") <= max_std_ms))
        .withColumn("dependent_type", F.when(F.col("co_ab") >= F.col("co_ba"), F.col("type_a")).otherwise(F.col("type_b")))
    )


def components(pairs: DataFrame, keys: list[str], a: str = "type_a", b: str = "type_b",
               small: int = SMALL_GRAPH) -> DataFrame:
    """(keys, type, group): every paired type with the smallest type it is connected to.

    Pairs link types, so there are normally a handful; up to ``small`` of them (checked) are joined
    on the driver. Larger graphs use minimum-label propagation with pointer jumping, whose rounds
    grow with the logarithm of the longest chain.
    """
    links = pairs.select(*keys, F.col(a).alias("x"), F.col(b).alias("y")).distinct()
    head = links.limit(small + 1).collect()
    if len(head) > small:
        return _propagate(links, keys)
    schema = T.StructType([links.schema[k] for k in keys] + [
        T.StructField("type", links.schema["x"].dataType), T.StructField("group", links.schema["x"].dataType)])
    root: dict[tuple, tuple] = {}

    def find(node):
        while root.setdefault(node, node) != node:
            node = root[node]
        return node

    for *run, x, y in head:
        low, high = sorted([find((*run, x)), find((*run, y))])
        root[high] = low
    return pairs.sparkSession.createDataFrame([(*n, find(n)[-1]) for n in list(root)], schema)


def _propagate(links: DataFrame, keys: list[str]) -> DataFrame:
    back = links.select(*keys, F.col("y").alias("x"), F.col("x").alias("y"))
    edges = materialize(links.unionByName(back).distinct())
    comp = materialize(edges.groupBy(*keys, F.col("x").alias("type")).agg(F.min("y").alias("_y")).select(
        *keys, "type", F.least("type", "_y").alias("group")))
    while True:
        hop = edges.join(comp.withColumnRenamed("type", "y"), keys + ["y"]).groupBy(
            *keys, F.col("x").alias("type")).agg(F.min("group").alias("_g"))
        step = comp.join(hop, keys + ["type"]).withColumn("_g", F.least("group", "_g"))
        jump = comp.select(*keys, F.col("type").alias("_g"), F.col("group").alias("_j"))
        new = materialize(step.join(jump, keys + ["_g"], "left").select(
            *keys, "type", F.least("_g", "_j").alias("group"), F.col("group").alias("_old")))
        comp = new.drop("_old")
        if new.where("group <> _old").isEmpty():
            return comp


def relabel_groups(spikes: DataFrame, groups: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Give every member of a group the smallest label of the group. No spike is dropped."""
    g = groups.select(*keys, F.col("type").alias(label), F.col("group").alias("_g"))
    return attach(spikes, g, keys + [label], "left").withColumn(
        label, F.coalesce("_g", label)).select(*spikes.columns)


def merge_linked(spikes: DataFrame, groups: DataFrame, keys: list[str], max_latency: float,
                 label: str = "label") -> DataFrame:
    """Merge linked types, then flag the duplicate detections of one discharge (``keep``)."""
    return min_isi(relabel_groups(spikes, groups, keys, label), keys + [label], max_latency)


# --- scoring ------------------------------------------------------------------------------------

def match_truth(est: DataFrame, truth: DataFrame, keys: list[str], tol: float, t: str = "t",
                sid: str = "spike_id") -> DataFrame:
    """Add ``matched_unit``: the unit of the nearest true discharge within ``tol``, else -1.

    Of two equally near discharges the earlier one wins. True discharges at the same instant are
    first reduced to one row, which also spreads a heavily repeated instant.
    """
    inst = truth.groupBy(*keys, t).agg(F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    empty = F.lit(None)
    both = est.select(*keys, t, sid, empty.cast("struct<t:double,lo:long,hi:long>").alias("_u")).unionByName(
        inst.select(*keys, t, F.lit(-1).cast("long").alias(sid),
                    F.struct(F.col(t).alias("t"), F.col("lo").cast("long").alias("lo"),
                             F.col("hi").cast("long").alias("hi")).alias("_u")))
    rows = neighbours(both, keys, [t, sid], prev={"_p": F.col("_u")}, nxt={"_n": F.col("_u")})
    rows = rows.where(F.col("_u").isNull())
    dp, dn = F.col(t) - F.col("_p.t"), F.col("_n.t") - F.col(t)
    use_next = dp.isNull() | (dn < dp)
    dist = F.when(use_next, dn).otherwise(dp)
    unit = F.when(use_next | (dp == 0), F.when(use_next, F.col("_n.lo")).otherwise(F.col("_p.lo"))).otherwise(
        F.col("_p.hi"))
    hits = rows.select(*keys, sid, F.when(dist <= tol, unit).otherwise(F.lit(-1)).alias("matched_unit"))
    return est.join(hits, keys + [sid])


def purity(matched: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Majority unit per type and its share of all members, unmatched ones included."""
    votes = matched.groupBy(*keys, label, "matched_unit").agg(F.count(F.lit(1)).alias("_n"))
    live = F.col("matched_unit") >= 0
    top = F.max(F.when(live, F.struct(F.col("_n").alias("n"), (-F.col("matched_unit")).alias("u"))))
    out = votes.groupBy(*keys, label).agg(F.sum("_n").alias("n_spikes"), top.alias("_t"))
    return out.select(
        *keys, label, "n_spikes", F.coalesce(-F.col("_t.u"), F.lit(-1)).cast("long").alias("est_match"),
        F.coalesce(F.col("_t.n") / F.col("n_spikes"), F.lit(0.0)).alias("purity"))


def recovery_summary(pur: DataFrame, keys: list[str]) -> DataFrame:
    agg = [
        F.count(F.lit(1)).alias("n_types"),
        F.countDistinct(F.when(F.col("est_match") >= 0, F.col("est_match"))).alias("n_recovered"),
        F.avg("purity").alias("mean_purity"),
        (F.sum(F.col("purity") * F.col("n_spikes")) / F.sum("n_spikes")).alias("weighted_purity"),
    ]
    return pur.groupBy(*keys).agg(*agg) if keys else pur.agg(*agg)


def confusion(matched: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Counts of matched spikes for every true unit and type that have any; cells without a spike count zero."""
    counts = matched.where("matched_unit >= 0").groupBy(*keys, "matched_unit", label).agg(F.count(F.lit(1)).alias("n"))
    types = counts.groupBy(*keys).agg(F.collect_set(label).alias("_t")) if keys else counts.agg(F.collect_set(label).alias("_t"))
    cells = attach(counts.select(*keys, "matched_unit").distinct(), types, keys).select(*keys, "matched_unit", F.explode("_t").alias(label))
    return cells.join(counts, [*keys, "matched_unit", label], "left").fillna(0, ["n"])


def best_type_per_unit(pur: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """For each recovered unit, its types by size; rank 1 is the largest."""
    w = Window.partitionBy(*keys, "est_match").orderBy(F.col("n_spikes").desc(), label)
    return pur.where("est_match >= 0").withColumn("rank", F.row_number().over(w).cast("long"))
