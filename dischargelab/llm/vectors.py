"""Vectors in parts: every query of a stated set against all rows, part by part.

Rows are range-partitioned into parts of some thousand vectors. Each part is packed into binary rows, and so are
its queries, in tiles. Then every tile is sent to every part; a part's rows come first and stay in memory
while tiles stream by. Neither side is ever gathered: memory holds one part and one tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.llm.words import mixed
from dischargelab.session import materialize, shuffle_width

PACKED = "part long, kind int, seq int, ids binary, data binary, extra binary"
BLOCK, TILE = 0, 1  # kinds


def finite_vectors(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, asks): rows with an id and a vector of finite components."""
    v = vectors[vec_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd).withColumn("asks", F.coalesce("asks", F.lit(False)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def packed(rows: list[tuple]) -> pa.RecordBatch:
    names = ("part", "kind", "seq", "ids", "data", "extra")
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def make_parts(rows: DataFrame, order: list[str], n_parts: int, width: int, pack: Callable) -> DataFrame:
    """``pack(part, ids, matrix, asks)`` gives the packed rows of one part; parts are ranges of ``order``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [(b.column("vec_id").to_numpy(), matrix(b.column("v"), width), b.column("asks").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if got:
            ids, x, asks = (np.concatenate(c) for c in zip(*got, strict=True))
            yield packed(pack(TaskContext.get().partitionId(), ids, x, asks.astype(bool)))

    ranged = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).select("vec_id", "v", "asks")
    return materialize(ranged.mapInArrow(kernel, PACKED))


def query_rows(ids: np.ndarray, x: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Places of a part's queries; equal rows are one query. Ranges of parts keep them together."""
    at = np.flatnonzero(asks)
    _, first = np.unique(np.c_[ids[at].astype("<i8").view("<f8"), x[at]].view(np.uint64), axis=0, return_index=True)
    return at[np.sort(first)]


def query_turn(x: np.ndarray) -> np.ndarray:
    """A hash of each query's vector; of several queries with one id the least counts."""
    turn = np.zeros(len(x), np.uint64)
    for column in (np.ascontiguousarray(x) + 0.0).view(np.uint64).T:
        turn = mixed(turn * np.uint64(0x9E3779B97F4A7C15) + column)
    return turn.view(np.int64)


def match_tiles(parts: DataFrame, n_parts: int, build: Callable, score: Callable, kind_of_score: str = "double") -> DataFrame:
    """(query_id, turn, vec_id, score) from ``score(build(blocks of a part), tile)`` for every part and tile."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, built = None, [], None
        for b in batches:
            for p, kind, _, *payload in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if p != part:
                    part, blocks, built = p, [], None
                if kind == BLOCK:
                    blocks.append(payload)
                elif blocks:
                    built = build(blocks) if built is None else built
                    ids, x, found = score(built, payload)
                    n = [len(v) for v, _ in found]
                    yield pa.record_batch({"query_id": pa.array(np.repeat(ids, n), pa.int64()), "turn": pa.array(np.repeat(query_turn(x), n), pa.int64()),
                                           "vec_id": pa.array(np.concatenate([v for v, _ in found]), pa.int64()),
                                           "score": pa.array(np.concatenate([s for _, s in found]))})

    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long")))
    tiles = parts.where(F.col("kind") == TILE).withColumn("part", everywhere)
    both = parts.where(F.col("kind") == BLOCK).unionByName(tiles)
    n = shuffle_width(parts.sparkSession)
    return both.repartition(n, "part").sortWithinPartitions("part", "kind", "seq").mapInArrow(
        kernel, f"query_id long, turn long, vec_id long, score {kind_of_score}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query; ties to the smaller vec_id. Of several vectors that ask with one id one counts."""
    found = found.withColumn("least", F.min("turn").over(Window.partitionBy("query_id"))).where("turn = least")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
