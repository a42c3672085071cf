"""Deterministic hash-ordered samples: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.session import attach

SPACE = 1 << 32


def hash_sample(df: DataFrame, keys: list[str], sid: str, n: int, seed: int) -> DataFrame:
    """Up to ``n`` rows per key, the smallest md5 of ``seed:id`` first.

    A threshold on the hash, set from the group's count, cuts large groups to a few times ``n``
    rows before they are ranked; it widens until every group can fill its sample.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(sid).cast("string"))), 1, 8), 16, 10).cast("long")
    rows = df.withColumn("_h", h)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    slack = 2.0
    while True:
        limit = F.ceil(F.lit(slack * (n + 50) * SPACE) / F.col("_cnt"))
        near = attach(rows, size, keys).where(F.col("_h") < limit)
        got = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_got"))
        short = (size.join(got, keys, "left") if keys else size.crossJoin(got)).where(
            F.coalesce("_got", F.lit(0)) < F.least(F.col("_cnt"), F.lit(n)))
        if short.isEmpty():
            break
        slack *= 4
    w = Window.partitionBy(*keys).orderBy("_h", sid)
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(*df.columns)
