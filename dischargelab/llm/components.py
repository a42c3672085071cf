"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dischargelab.session import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and its partners; minima are combined before the shuffle.

    The join stays a shuffled one, which no round then has to build and keep on the driver for a broadcast.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return pairs.join(least.hint("shuffle_hash"), "u")


def _oriented(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of an edge (a, b): the smallest vertex that it can reach.

    A vertex with very many partners is a hot join key, which AQE splits; no group is gathered. Each
    round cuts lineage by a checkpoint. Rounds grow with the logarithm of the longest chain.
    Self-loops and nulls are ignored, so a vertex with no other edge is absent.
    """
    now = materialize(_oriented(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")))
    seen = None
    while (state := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != seen:
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _oriented(_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _star(large)
        now = materialize(_oriented(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))))
    roots = now.select(F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(roots.select(F.col("root").alias("v"), "root"))
