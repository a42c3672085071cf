"""Hierarchical weighted hash tree: which shard takes a document, with SQL functions only.

A document descends region, rack and shard. At every level each child draws -ln(u) / weight, with u
from a hash of the document key and the child's path, and the smallest draw wins: a child is taken
with the probability of its weight, and a draw depends on nothing but key, path and weight. So when
a weight changes, documents move only into or out of the subtree whose weight changed. A shard that
opens as a region of its own (``topology`` adds later shards so) takes documents only into itself;
a shard added inside a region moves documents only into that region and within it.

Slots number a shard's rows without gaps: rows are numbered inside (shard, bucket), and the counts of
these cells (at most shards x ``BUCKETS`` rows, whatever the input) give each bucket's offset.

Defined cases: a null text has no bytes (size 16) and checksum 0; a null doc_id is one key of its own;
rows that repeat a doc_id share a shard and have slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.llm.common import slim, table
from dischargelab.session import materialize

SHARDS, BASE, RACKS_PER_REGION, SHARDS_PER_RACK = 40, 40, 2, 5
OVERHEAD = 16
BUCKETS = 256  # two hex digits of a hash


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = BASE, weight: float = 1.0) -> list[Leaf]:
    """The first ``base`` shards in racks and regions; each later one opens a region of its own."""
    tree = []
    for s in range(shards):
        rack = s // SHARDS_PER_RACK
        region = f"r{rack // RACKS_PER_REGION}" if s < base else f"own{s}"
        tree.append(Leaf(region, f"{region}/k{rack if s < base else 0}", s, weight))
    return tree


def _grouped(tree: list[Leaf], level: str) -> dict[str, float]:
    total: dict[str, float] = {}
    for leaf in tree:
        total[getattr(leaf, level)] = total.get(getattr(leaf, level), 0.0) + leaf.weight
    return total


def _draw(path: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(F.col("key"), F.lit("|" + path))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**13))
    return -F.log(u) / F.lit(weight)


def _winner(children: dict, value) -> Column:
    """``value`` of the child with the smallest draw; a sole child needs no draw."""
    if len(children) == 1:
        return F.lit(value(next(iter(children))))
    draws = [F.struct(_draw(str(c), w).alias("draw"), F.lit(value(c)).alias("child")) for c, w in children.items()]
    return F.array_min(F.array(*draws))["child"]


def _case(column: str, options: dict[str, Column]) -> Column:
    out = None
    for name, c in options.items():
        out = (F if out is None else out).when(F.col(column) == name, c)
    return out


def descend(df: DataFrame, tree: list[Leaf], out: str) -> DataFrame:
    """Adds column ``out``: the shard that column ``key`` reaches in ``tree``."""
    regions = _grouped(tree, "region")
    df = df.withColumn("_region", _winner(regions, str))
    racks = {r: _grouped([x for x in tree if x.region == r], "rack") for r in regions}
    df = df.withColumn("_rack", _case("_region", {r: _winner(k, str) for r, k in racks.items()}))
    leaves = {k: {f"{k}/s{x.shard}": x.weight for x in tree if x.rack == k} for r in racks.values() for k in r}
    shard = _case("_rack", {k: _winner(v, lambda p: int(p.rpartition("s")[2])) for k, v in leaves.items()})
    return df.withColumn(out, shard.cast("int")).drop("_region", "_rack")


def number_slots(df: DataFrame, group: str, bucket: str, order: list[str]) -> DataFrame:
    """Adds ``slot``, gapless from 0 inside ``group``; buckets are numbered apart from each other."""
    cells = df.groupBy(group, bucket).agg(F.count("*").alias("rows"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(group, bucket, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    cell = Window.partitionBy(group, bucket).orderBy(*order)
    numbered = df.withColumn("nth", F.row_number().over(cell) - 1)
    return numbered.join(F.broadcast(starts), [group, bucket]).withColumn("slot", F.col("start") + F.col("nth")).drop("start", "nth")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row, and the shard it would have with one more."""
    text = F.coalesce("text", F.lit(""))
    rows = slim(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("key"))
    placed = descend(descend(rows, topology(shards), "shard"), topology(shards + 1), "grown_shard")
    placed = materialize(placed.withColumn("bucket", F.substring(F.md5("key"), 1, 2)).drop("key"))
    return number_slots(placed, "shard", "bucket", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op7(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
