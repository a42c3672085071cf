"""Session settings, materialization and the size checks every operator shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A window, grouped kernel or exact built-in percentile may see at most this many rows of one
# group. Groups beyond it take the segmented path (operators/ordered.py), which has no hot task.
GROUP_ROWS_CONF = "dischargelab.maxGroupRows"
GROUP_ROWS_DEFAULT = 2_000_000


def get_spark(app: str = "dischargelab", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    n = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Only a local master, whose tasks share one disk, may leave it unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="dischargelab-", dir="/tmp"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, so a lost executor costs a re-read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def group_bound(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_CONF, str(GROUP_ROWS_DEFAULT)))


def groups_bounded(df: DataFrame, keys: list[str], bound: int | None = None) -> bool:
    """True when no group of ``keys`` is larger than the bound (one map-side-combined count)."""
    return largest_group(df, keys) <= (group_bound(df.sparkSession) if bound is None else bound)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Largest small side that is broadcast, in rows and in bytes; it holds one row per run, type or coefficient.
BROADCAST_ROWS_CONF = "dischargelab.maxBroadcastRows"
BROADCAST_ROWS_DEFAULT = 20_000
BROADCAST_BYTES_CONF = "dischargelab.maxBroadcastBytes"
BROADCAST_BYTES_DEFAULT = 32 << 20


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_BYTES_CONF, str(BROADCAST_BYTES_DEFAULT)))


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a per-key summary onto rows without shuffling a hot key.

    The small side is fetched up to the bound. If that is all of it, it comes back as a local
    relation and is broadcast, so the big side keeps its partitioning; beyond the bound keys are
    many and the join is left to the planner and AQE's skew handling. With no key the small side is
    a single row.
    """
    if not on:
        head = small.limit(2).toArrow()
        if head.num_rows > 1:
            raise ValueError("without a key the small side must be a single row")
        return big.crossJoin(F.broadcast(big.sparkSession.createDataFrame(head, small.schema)))
    conf = big.sparkSession.conf
    limit = int(conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS_DEFAULT)))
    head = small.limit(limit + 1).toArrow()
    if head.num_rows <= limit and head.nbytes <= broadcast_bytes(big.sparkSession):
        small = F.broadcast(big.sparkSession.createDataFrame(head, small.schema))
    return big.join(small, on, how)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group (one map-side-combined count)."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
