"""Traces as fixed-size blocks with halo: the unit of work of every signal operator.

A run may hold a third of all samples, so nothing windows over a run. Samples are grouped by
(run, block), where a block is ``size`` consecutive sample indices, and the samples a filter or a
moving window needs from either side are replicated into the block. Block groups are bounded by
construction and stay hash-partitioned on (run, block), so the windows that follow add no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLK = "_blk"
OWN = "_own"


def with_halo(trace: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Replicate each sample into every block that needs it; ``_own`` marks its home block.

    ``before``/``after`` count the samples a block needs to the left and right of its own span.
    """
    home = F.floor(F.col("i") / size)
    # A sample i lies in the halo of block b when b*size - before <= i < (b+1)*size + after.
    low = F.greatest(F.floor((F.col("i") - F.lit(after)) / size), F.lit(0))
    high = F.floor((F.col("i") + F.lit(before)) / size)
    return (
        trace.withColumn(BLK, F.explode(F.sequence(low, high)))
        .withColumn(OWN, F.col(BLK) == home)
    )


def block_window(keys: list[str], order: str = "i") -> Window:
    return Window.partitionBy(*keys, BLK).orderBy(order)


def chunks(trace: DataFrame, keys: list[str], size: int, before: int, after: int,
           value: str = "v") -> DataFrame:
    """One array row per (run, block): ``i0`` is the index of the first element, halo included."""
    spread = with_halo(trace.select(*keys, "i", value), size, before, after)
    packed = spread.groupBy(*keys, BLK).agg(
        F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v")))).alias("_s")
    )
    return (
        packed.withColumn("i0", F.col("_s")[0]["i"])
        .withColumn("v", F.transform("_s", lambda s: s["v"]))
        .where((F.col("i0") <= F.col(BLK) * size + size - 1)
               & (F.col("i0") + F.size("v") > F.col(BLK) * size))
        .drop("_s")
    )
