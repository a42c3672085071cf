"""Exact top-k by inner product with block-at-a-time pruning.

Components become integers, as term weights are. Vectors whose largest component is the same lie next to each
other, and ranges of that order form blocks. A block keeps the largest and smallest weight of every term and
its vectors as a forward index. For a query the terms' best contributions, summed, bound every score in
the block. Blocks are scored in the order of their bounds, until a bound falls below the query's k-th
score so far. Each query starts with the k-th score inside its own part, a lower bound everywhere.

Results are exact: only blocks whose bound is strictly below the k-th score are left out, so ties stay.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; a shorter vector ends in zeros; rows that repeat a vec_id are candidates of their own, but never of
queries with that id; of several query rows with one id one asks (chosen by a hash of its vector); fewer candidates
than k give them all; an empty table gives no rows. Scores are computed in double precision where that is exact, and in
64-bit integers beyond; sums that could pass 64 bits, which a score can't hold, are an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dischargelab.llm.common import table
from dischargelab.llm.vectors import BLOCK, TILE, finite_vectors, make_parts, match_tiles, query_rows, ranked

K, EVERY, SCALE = 5, 50, 256
PART, BLOCK_ROWS, TILE_ROWS = 8192, 512, 256
NONE = np.iinfo(np.int64).min


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Blocks:
    """Forward indexes of a part's blocks, with the range of every term."""

    def __init__(self, ids: list[np.ndarray], rows: list[np.ndarray], whole: bool = False):
        self.ids, self.rows, self.whole = ids, rows, whole
        self.high = np.array([r.max(axis=0) for r in rows])
        self.low = np.array([r.min(axis=0) for r in rows])
        self.size = np.maximum(np.abs(self.high), np.abs(self.low))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        slack = np.abs(queries) @ self.size.T * 1e-12  # more than rounding can take away
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T + slack

    def scores(self, block: int, query: np.ndarray) -> np.ndarray:
        rows = self.rows[block]
        return (rows.astype(np.int64) * query.astype(np.int64)).sum(axis=1) if self.whole else (rows @ query).astype(np.int64)

    def top(self, own: int, query: np.ndarray, bounds: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's best here; scores below ``floor`` may be left out."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] < floor:
                break
            s = self.scores(b, query)
            hit = (s >= floor) & (self.ids[b] != own)
            ids, scores = np.r_[ids, self.ids[b][hit]], np.r_[scores, s[hit]]
            keep = best(ids, scores, k)
            ids, scores = ids[keep], scores[keep]
            if len(scores) == k:
                floor = max(floor, int(scores[-1]))
        return ids, scores


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of every query row against all rows."""
    rows = finite_vectors(vectors, is_query, id_col, vec_col)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(SCALE)) * x).cast("double")))
    size = F.transform("v", F.abs)
    peak = F.array_position(size, F.array_max(size)).cast("int")
    rows = rows.withColumn("peak", F.coalesce(F.when(peak > 0, peak * F.signum(F.try_element_at("v", F.greatest(peak, F.lit(1))))), F.lit(0.0)))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)  # no score, and no part of its sum, is larger
    n, width, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    n_parts, width = max(1, -(-n // PART)), max(width or 0, 1)
    whole = (top or 0.0) >= 2**53
    if (top or 0.0) >= 2**63:
        raise ValueError("a score may not fit into 64 bits")

    def pack(part, ids, x, asks):
        starts = range(0, len(ids), BLOCK_ROWS)
        blocks = Blocks([ids[i: i + BLOCK_ROWS] for i in starts], [x[i: i + BLOCK_ROWS] for i in starts], whole)
        out = [(part, BLOCK, i, a.tobytes(), r.tobytes(), b"") for i, (a, r) in enumerate(zip(blocks.ids, blocks.rows, strict=True))]
        asked = query_rows(ids, x, asks)
        for i in range(0, len(asked), TILE_ROWS):
            at = asked[i: i + TILE_ROWS]
            bounds = blocks.bounds(x[at])
            own = [blocks.top(ids[q], x[q], b, NONE, k)[1] for q, b in zip(at, bounds, strict=True)]
            floors = np.array([s[-1] if len(s) == k else NONE for s in own], np.int64)
            out.append((part, TILE, i, ids[at].tobytes(), x[at].tobytes(), floors.tobytes()))
        return out

    def build(blocks):
        return Blocks([np.frombuffer(i, np.int64) for i, _, _ in blocks], [np.frombuffer(d).reshape(-1, width) for _, d, _ in blocks], whole)

    def score(blocks, tile):
        ids, x, floors = (np.frombuffer(t, d) for t, d in zip(tile, (np.int64, float, np.int64), strict=True))
        x = x.reshape(-1, width)
        return ids, x, [blocks.top(*q, k) for q in zip(ids, x, blocks.bounds(x), floors, strict=True)]

    parts = make_parts(rows, ["peak", "vec_id"], n_parts, width, pack)
    return ranked(match_tiles(parts, n_parts, build, score, "long"), k)


def op4(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.expr(f"vec_id % {EVERY} = 0"))


OP4_SQL = f"""
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {K}
"""
