"""Split tests of types, and merges of types that sit next to each other in an embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dischargelab.operators import fits as FT
from dischargelab.operators import gap as GP
from dischargelab.operators.features import pca_by_pool
from dischargelab.operators.linkage import components
from dischargelab.operators.tiles import silhouette
from dischargelab.operators.trains import relabel_dense
from dischargelab.session import attach, materialize

SID = "spike_id"
SEED = 42


def two_way(rows: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """Propose a two-way partition of each group of at least ``min_rows``: k-means on its two leading components.

    Both steps are passes over all rows of all groups, so the proposal is the same algorithm at every size. Returns (rows
    with ``sub`` and ``labels``, sizes and silhouette per group).
    """
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    live = attach(rows, n.where(F.col("n") >= min_rows), ["g"]).select("g", SID, "x")
    plane = materialize(pca_by_pool(live, 2).select("g", SID, F.col("shape").alias("x")))
    fits = FT.kmeans(plane, SID, [2], SEED)
    sub = materialize(FT.assign(plane, {g: f for (g, _), f in fits.items()}, "sub").withColumn("labels", F.array("sub")))
    return sub, partition_tests(sub)


def partition_tests(sub: DataFrame) -> DataFrame:
    """(g, n, n0, n1, silhouette) of given two-way partitions (g, spike_id, x, sub, labels)."""
    sil = silhouette(sub, SID).select("g", "silhouette")
    size = sub.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("sub") == 0, 1).otherwise(0)).alias("n0"),
                                F.sum(F.when(F.col("sub") == 1, 1).otherwise(0)).alias("n1"))
    return materialize(size.join(sil, "g", "left"))


def _types_as_groups(waves: DataFrame) -> DataFrame:
    return waves.select(F.col("label").cast("int").alias("g"), SID, "x")


def _apply(waves: DataFrame, sub: DataFrame, split: list[int], next_id: int) -> DataFrame:
    """Move the second child of every split type to a fresh id, in type order."""
    if not split:
        return waves
    fresh = F.create_map(*[F.lit(v) for n, g in enumerate(sorted(split)) for v in (int(g), next_id + n)])
    moved = sub.where(F.col("g").isin(sorted(split)) & (F.col("sub") == 1)).select(SID, fresh[F.col("g")].alias("_new"))
    return waves.join(moved, SID, "left").withColumn("label", F.coalesce("_new", "label").cast("int")).select(*waves.columns)


def split_by_silhouette(waves: DataFrame, min_spikes: int = 20, floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """One pass: split a type when the silhouette of its two-way partition reaches ``floor``.

    Labels are not renumbered. The report has one row per type, with the id of the second child (the first keeps the type's)
    where it was split; untested types have no silhouette.
    """
    counts = waves.groupBy(F.col("label").cast("int").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sub, tests = two_way(_types_as_groups(waves), min_spikes)
    split = [r["g"] for r in tests.where(F.col("silhouette") >= floor).select("g").collect()]
    top = waves.agg(F.max("label")).first()[0] + 1
    report = counts.join(tests.select("g", "silhouette", "n0", "n1"), "g", "left").withColumn(
        "split", F.coalesce(F.col("silhouette") >= floor, F.lit(False)))
    place = F.array_position(F.array(*[F.lit(g) for g in sorted(split)]).cast("array<int>"), F.col("g"))
    report = report.withColumn("child", F.when(F.col("split"), (place + int(top) - 1).cast("int"))).withColumnRenamed("g", "type")
    return _apply(waves, sub, split, int(top)), report


def split_by_gap(waves: DataFrame, min_spikes: int = 50, min_child: int = 20, margin: float = 1.0, max_rounds: int = 3,
                 space: str = "waves", n_refs: int = GP.N_REFS) -> tuple[DataFrame, list[dict]]:
    """Repeat: propose two-way partitions of every type and keep those the gap statistic prefers.

    The gap is scored on the waveforms' leading components
    with that partition fixed (``space="waves"``), or on the plane of the proposal (``"plane"``). Labels
    come back dense. The report names the second child of a split type by its id before that.
    """
    report = []
    for rnd in range(max_rounds):
        sub, tests = two_way(_types_as_groups(waves), min_spikes)
        ready = {r["g"]: r for r in tests.where("n0 > 0 and n1 > 0").collect()}
        if space == "plane":
            data = sub.select(SID, F.col("g").alias("label"), "x")
            gaps = GP.gap_statistics(data, [(g,) for g in sorted(ready)], SID, n_refs)
        else:
            data = materialize(waves.where(F.col("label").isin(sorted(ready)))) if ready else waves.limit(0)
            gaps = _gap_fixed(data, sub, sorted(ready), n_refs)
        split = []
        for r in gaps:
            g = r["members"][0]
            keep = r["gap2"] - r["gap1"] > margin * r["s2"] and min(ready[g]["n0"], ready[g]["n1"]) >= min_child
            report.append({"round": rnd, "type": g, "n": r["n"], "split": bool(keep), "gap1": r["gap1"], "gap2": r["gap2"], "s2": r["s2"]})
            split += [g] if keep else []
        top = int(waves.agg(F.max("label")).first()[0]) + 1
        children = {g: top + n for n, g in enumerate(sorted(split))}
        for row in report:
            if row["round"] == rnd:
                row["child"] = children.get(row["type"])
        waves = materialize(relabel_dense(_apply(waves, sub, split, top), []).select(*waves.columns))
        if not split:
            break
    return waves, report


def _gap_fixed(data: DataFrame, sub: DataFrame, groups: list[int], n_refs: int) -> list[dict]:
    if not groups:
        return []
    child = data.join(sub.select(SID, "sub"), SID).withColumn("label", F.col("label") * 2 + F.col("sub"))
    parts = GP.type_moments(GP._ids(child, SID))
    whole = {g: parts[2 * g] + parts[2 * g + 1] for g in groups}
    within = {}
    for g in groups:
        axes = GP.make_pool((g,), whole).axes
        w = 0.0
        for c in (2 * g, 2 * g + 1):
            n, s, ss = GP._split(parts[c])
            w += float(np.trace(axes.T @ (ss - np.outer(s, s) / n) @ axes))
        within[(g,)] = w
    return GP.gap_statistics(data, [(g,) for g in groups], SID, n_refs, within2=within, moments=whole)


def pair_pools(waves: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Rows of every pooled pair, ``g`` numbering the pairs in order."""
    of: dict[int, list[int]] = {}
    for n, (a, b) in enumerate(pairs):
        of.setdefault(a, []).append(n)
        of.setdefault(b, []).append(n)
    table = F.create_map(*[v for t, ps in sorted(of.items()) for v in (F.lit(t), F.array(*[F.lit(p) for p in ps]))])
    return waves.withColumn("g", F.explode(table[F.col("label").cast("int")])).select("g", SID, "x")


def pairs_one_cluster(waves: DataFrame, pairs: list[tuple[int, int]], floor: float = 0.5, min_spikes: int = 20) -> dict[tuple[int, int], float | None]:
    """Two-way silhouette of each pooled pair; None where the pool is too small to test."""
    if not pairs:
        return {}
    _, tests = two_way(pair_pools(waves, pairs), min_spikes)
    got = {r["g"]: r["silhouette"] for r in tests.collect()}
    return {p: got.get(n) for n, p in enumerate(pairs)}


# --- adjacency in a plane -----------------------------------------------------------------------

def centroids(points: DataFrame, y: str = "y") -> DataFrame:
    return points.groupBy("label").agg(F.avg(F.col(y)[0]).alias("cx"), F.avg(F.col(y)[1]).alias("cy"))


def voronoi_adjacency(cent: DataFrame) -> DataFrame:
    """(type_a, type_b) whose Voronoi cells share a ridge: edges of empty-circumcircle triangles.

    Input is one row per type. Triples and their containment test are self joins of that table.
    """
    p = [cent.select(F.col("label").alias(f"t{k}"), F.col("cx").alias(f"x{k}"), F.col("cy").alias(f"y{k}")) for k in (1, 2, 3, 4)]
    tri = p[0].join(p[1], F.col("t1") < F.col("t2")).join(p[2], F.col("t2") < F.col("t3"))
    x, y = (lambda k: F.col(f"x{k}")), (lambda k: F.col(f"y{k}"))
    d = (x(1) * (y(2) - y(3)) + x(2) * (y(3) - y(1)) + x(3) * (y(1) - y(2))) * 2.0
    sq = {k: x(k) * x(k) + y(k) * y(k) for k in (1, 2, 3)}
    tri = tri.withColumn("_d", d).where("_d <> 0")
    tri = tri.withColumn("_ux", (sq[1] * (y(2) - y(3)) + sq[2] * (y(3) - y(1)) + sq[3] * (y(1) - y(2))) / F.col("_d"))
    tri = tri.withColumn("_uy", (sq[1] * (x(3) - x(2)) + sq[2] * (x(1) - x(3)) + sq[3] * (x(2) - x(1))) / F.col("_d"))
    r2 = F.pow(x(1) - F.col("_ux"), 2) + F.pow(y(1) - F.col("_uy"), 2)
    inside = (F.pow(x(4) - F.col("_ux"), 2) + F.pow(y(4) - F.col("_uy"), 2) < F.col("_r2") * (1 - 1e-12)) & (
        ~F.col("t4").isin(F.col("t1"), F.col("t2"), F.col("t3")))
    empty = tri.withColumn("_r2", r2).join(p[3], inside, "left_anti")
    edges = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("t1", "t2"), ("t1", "t3"), ("t2", "t3"))])
    return empty.select(F.explode(edges).alias("e")).select(F.col("e.a").alias("type_a"), F.col("e.b").alias("type_b")).distinct()


def merge_adjacent(waves: DataFrame, points: DataFrame, floor: float = 0.5) -> tuple[DataFrame, list[dict]]:
    """Merge neighbouring types whose pooled waveforms do not split; ids follow the smallest member."""
    pairs = sorted((r["type_a"], r["type_b"]) for r in voronoi_adjacency(centroids(points)).collect())
    sil = pairs_one_cluster(waves, pairs, floor)
    log = [{"type_a": a, "type_b": b, "silhouette": sil[a, b], "merge": not (sil[a, b] is not None and sil[a, b] >= floor)}
           for a, b in pairs]
    merged = [(0, r["type_a"], r["type_b"]) for r in log if r["merge"]]
    if merged:
        spark = waves.sparkSession
        comp = components(spark.createDataFrame(merged, "run int, type_a int, type_b int"), ["run"])
        g = comp.select(F.col("type").alias("label"), F.col("group").alias("_g"))
        waves = attach(waves, g, ["label"], "left").withColumn("label", F.coalesce("_g", "label")).select(*waves.columns)
    return relabel_dense(waves, []).select(*waves.columns), log


def voronoi_cells(cent: DataFrame, radius: float) -> DataFrame:
    """(label, corner, px, py): each type's Voronoi cell, cut to a square of half-width ``radius``.

    The input is one row per type; the cell of one type is a square cut by the bisector to every
    other type.
    """
    others = cent.agg(F.collect_list(F.struct("label", "cx", "cy")).alias("_all"))
    rows = cent.crossJoin(others)  # one row on the right

    @F.pandas_udf("array<struct<px:double,py:double>>")
    def cell(label: pd.Series, cx: pd.Series, cy: pd.Series, every: pd.Series) -> pd.Series:
        out = []
        for lab, x, y, pts in zip(label, cx, cy, every):
            mx = float(np.mean([q["cx"] for q in pts]))
            my = float(np.mean([q["cy"] for q in pts]))
            poly = [np.array([mx + a * radius, my + b * radius]) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
            me = np.array([x, y])
            for q in pts:
                if q["label"] == lab:
                    continue
                to = np.array([q["cx"], q["cy"]]) - me
                cut = to @ (me + to / 2)
                side = [p @ to - cut for p in poly]
                new = []
                for k, p in enumerate(poly):
                    nxt, sk, sn = poly[(k + 1) % len(poly)], side[k], side[(k + 1) % len(poly)]
                    if sk <= 0:
                        new.append(p)
                    if (sk < 0 < sn) or (sn < 0 < sk):
                        new.append(p + (nxt - p) * (sk / (sk - sn)))
                poly = new
            out.append([{"px": float(p[0]), "py": float(p[1])} for p in poly])
        return pd.Series(out)

    return rows.select("label", F.posexplode(cell("label", "cx", "cy", "_all")).alias("corner", "_p")).select(
        "label", "corner", "_p.px", "_p.py")
