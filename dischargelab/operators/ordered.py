"""Order-dependent operators that survive a key holding a third of all rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. Here that plan is used only
after a count has shown every key to be small. Otherwise the rows are range-partitioned on
(keys, order), which splits a hot key evenly because the order is unique, and every operator
becomes a two-level scan: a window inside each segment, a tiny window over one summary row per
(key, segment), and a join of the two.

``order`` is a list of column names, ascending, that must order the rows of a key totally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.session import attach, groups_bounded, materialize, shuffle_width

SEG = "_seg"


def segments(df: DataFrame, keys: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """Cut rows into ordered segments; ``_seg`` grows with (keys, order).

    The segment id depends on sampled range bounds, so it is pinned by a checkpoint before any
    plan reads it twice.
    """
    width = n or shuffle_width(df.sparkSession)
    cut = df.repartitionByRange(width, *[F.col(c) for c in keys + order])
    return materialize(cut.withColumn(SEG, F.spark_partition_id()))


def _order(cols: list[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def _split(df, keys, order, bounded):
    if bounded is None:
        bounded = groups_bounded(df, keys)
    return (df, keys, True) if bounded else (segments(df, keys, order), keys + [SEG], False)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                bounded: bool | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` per key."""
    part, inner, whole = _split(df, keys, order, bounded)
    part = part.withColumn("_v", value)
    w = Window.partitionBy(*inner).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = part.withColumn(out, F.sum("_v").over(w))
    if whole:
        return rows.drop("_v")
    outer = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    offset = (
        part.groupBy(*inner).agg(F.sum("_v").alias("_s"))
        .withColumn("_off", F.coalesce(F.sum("_s").over(outer), F.lit(0))).drop("_s")
    )
    return rows.join(offset, inner).withColumn(out, F.col(out) + F.col("_off")).drop("_v", "_off", SEG)


def row_index(df: DataFrame, keys: list[str], order: list[str], out: str = "i",
              bounded: bool | None = None) -> DataFrame:
    """0-based position of each row in its key."""
    one = running_sum(df, keys, order, F.lit(1).cast("long"), out, bounded)
    return one.withColumn(out, (F.col(out) - 1).cast("long"))


def neighbours(df: DataFrame, keys: list[str], order: list[str], prev: dict[str, Column] | None = None,
               nxt: dict[str, Column] | None = None, bounded: bool | None = None) -> DataFrame:
    """Add the nearest earlier (``prev``) / later (``nxt``) non-null value of an expression.

    The row itself is excluded. With an expression that is never null this is lag/lead; with a
    null-able one it is an as-of lookup. Later values use a descending running window, because an
    unbounded-following frame would be quadratic.
    """
    prev, nxt = prev or {}, nxt or {}
    part, inner, whole = _split(df, keys, order, bounded)
    sides = [(out, e, False) for out, e in prev.items()] + [(out, e, True) for out, e in nxt.items()]
    rows = part
    for out, e, _ in sides:
        rows = rows.withColumn(f"_x_{out}", e)
    hold = rows
    for out, _, desc in sides:
        w = (Window.partitionBy(*inner).orderBy(*_order(order, desc))
             .rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn(out, F.last(f"_x_{out}", ignorenulls=True).over(w))
    if not whole:
        at = F.struct(*order)
        edge = hold.groupBy(*inner).agg(*[
            (F.min if desc else F.max)(
                F.when(F.col(f"_x_{out}").isNotNull(), F.struct(at.alias("o"), F.col(f"_x_{out}").alias("x")))
            ).alias(f"_e_{out}") for out, _, desc in sides
        ])
        for out, _, desc in sides:
            o = (Window.partitionBy(*keys).orderBy(F.col(SEG).desc() if desc else F.col(SEG))
                 .rowsBetween(Window.unboundedPreceding, -1))
            edge = edge.withColumn(f"_c_{out}", F.last(F.col(f"_e_{out}.x"), ignorenulls=True).over(o))
        edge = edge.select(*inner, *[f"_c_{out}" for out, _, _ in sides])
        rows = rows.join(edge, inner)
        for out, _, _ in sides:
            rows = rows.withColumn(out, F.coalesce(F.col(out), F.col(f"_c_{out}")))
        rows = rows.drop(SEG, *[f"_c_{out}" for out, _, _ in sides])
    return rows.drop(*[f"_x_{out}" for out, _, _ in sides])


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str,
            bounded: bool | None = None) -> DataFrame:
    """Number maximal runs of rows; ``starts`` is true where a new run begins."""
    return running_sum(df, keys, order, starts.cast("long"), out, bounded)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              bounded: bool | None = None, pinned: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per entry of ``probs``.

    ``pinned`` says that rows are cheap to read again.


    The built-in exact ``percentile`` keeps every distinct value of a group in one buffer, so it is
    used only on bounded groups. Otherwise a mergeable sketch brackets every wanted rank, and a second
    pass counts what lies below a bracket and ranks the few values inside it, so values are not sorted or
    sent. Should a rank lie outside its bracket, values are range-sorted instead.
    """
    live = df.select(*keys, value).where(F.col(value).isNotNull() & ~F.isnan(value))
    if bounded is None:
        bounded = groups_bounded(live, keys)
    names = list(probs)
    if bounded:
        arr = F.percentile(value, F.array(*[F.lit(float(probs[n])) for n in names]))
        agg = live.groupBy(*keys).agg(arr.alias("_q")) if keys else live.agg(arr.alias("_q"))
        return agg.select(*keys, *[F.col("_q")[k].alias(n) for k, n in enumerate(names)])

    live = live if pinned else materialize(live)
    found = _bracketed(live, keys, value, probs)
    return _range_sorted(live, keys, value, probs) if found is None else found


SKETCH = 10_000  # ranks of a sketch are off by at most one part in so many


def _bracketed(live: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame | None:
    """The quantiles by a sketch and one count, or None if a rank was outside its bracket."""
    slack = 3.0 / SKETCH
    ends = [e for p in probs.values() for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    near = F.percentile_approx(value, F.array(*[F.lit(float(e)) for e in ends]), SKETCH).alias("_e")
    sketch = materialize(live.groupBy(*keys).agg(near, F.count(F.lit(1)).alias("_total")))
    wanted = F.array(*[
        F.struct(F.lit(n).alias("name"), ((F.col("_total") - 1) * F.lit(float(p))).alias("pos"),
                 (F.col("_e")[2 * i] if p > slack else F.lit(None)).alias("lo"), (F.col("_e")[2 * i + 1] if p < 1 - slack else F.lit(None)).alias("hi"))
        for i, (n, p) in enumerate(probs.items())])
    rows = attach(live, sketch.select(*keys, wanted.alias("_w")), keys).select(*keys, value, F.explode("_w").alias("_w"))
    rows = rows.where(F.col("_w.hi").isNull() | (F.col(value) <= F.col("_w.hi")))
    inside = F.when(F.col("_w.lo").isNull() | (F.col(value) >= F.col("_w.lo")), F.col(value))  # null: below the bracket
    tally = rows.groupBy(*keys, F.col("_w.name").alias("_name"), F.col("_w.pos").alias("_pos"), inside.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys, "_name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = tally.withColumn("_last", F.sum("_n").over(upto) - 1).withColumn("_first", F.col("_last") - F.col("_n") + 1).where("_v IS NOT NULL")
    at = lambda rank: F.max(F.when(rank.between(F.col("_first"), F.col("_last")), F.col("_v")))
    pick = materialize(ranked.groupBy(*keys, "_name", "_pos").agg(at(F.floor("_pos")).alias("_a"), at(F.ceil("_pos")).alias("_b")))
    if pick.where("_a IS NOT NULL AND _b IS NOT NULL").count() < sketch.where("_total > 0").count() * len(probs):
        return None
    q = F.col("_a") + (F.col("_pos") - F.floor("_pos")) * (F.col("_b") - F.col("_a"))
    return pick.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, q)).alias(n) for n in probs])


def _range_sorted(live: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    # Equal values carry the same quantile, so ties are collapsed to (value, count) first. This
    # also spreads a value that repeats without bound.
    tally = live.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    seg = segments(tally, keys, [value])
    outer = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*keys)
    summary = (
        seg.groupBy(*keys, SEG).agg(F.sum("_n").alias("_s"))
        .withColumn("_before", F.coalesce(F.sum("_s").over(outer), F.lit(0)))
        .withColumn("_total", F.sum("_s").over(total))
    )
    wanted = F.array(*[
        F.struct(F.lit(n).alias("name"),
                 ((F.col("_total") - 1) * F.lit(float(p))).alias("pos")) for n, p in probs.items()
    ])
    hit = (
        summary.withColumn("_w", F.explode(wanted))
        .withColumn("_lo", F.floor("_w.pos")).withColumn("_hi", F.ceil("_w.pos"))
        .where((F.col("_lo") < F.col("_before") + F.col("_s")) & (F.col("_hi") >= F.col("_before")))
        .select(*keys, SEG, "_before", F.col("_w.name").alias("_name"), F.col("_w.pos").alias("_pos"),
                "_lo", "_hi")
    )
    inner = Window.partitionBy(*keys, SEG).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        seg.join(hit.select(*keys, SEG).distinct(), keys + [SEG], "left_semi")
        .withColumn("_cum", F.sum("_n").over(inner))
        .join(hit, keys + [SEG])
        .withColumn("_last", F.col("_before") + F.col("_cum") - 1)
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )
    pick = ranked.groupBy(*keys, "_name").agg(
        F.max("_pos").alias("_pos"), F.max("_lo").alias("_lo"),
        F.max(F.when(F.col("_lo").between(F.col("_first"), F.col("_last")), F.col(value))).alias("_a"),
        F.max(F.when(F.col("_hi").between(F.col("_first"), F.col("_last")), F.col(value))).alias("_b"),
    ).withColumn("_q", F.col("_a") + (F.col("_pos") - F.col("_lo")) * (F.col("_b") - F.col("_a")))
    grouped = pick.groupBy(*keys) if keys else pick.groupBy()
    return grouped.agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probs])
