"""Approximate nearest neighbours by inner product with multi-index hashing.

Vectors get one more component so that all have the same length; then the largest inner product is the
smallest angle. Learned rotations (fitted to a bounded sample so that signs lose little) give
binary codes. A code is cut into bytes, and each byte position is a table: for every value the
bitmap of the vectors that hold it. If two codes differ in at most ``radius`` bits, then in some
byte position they differ in at most its threshold (the thresholds sum to radius - positions + 1). Bitmaps
of all values in such a ball are merged once per part, so probing a table is one lookup; what any
table returns is verified on the whole code and reranked by exact inner products.

The radius is fitted on the sample to hold nearly all true neighbours; there they lie farther apart than
in the whole table, which errs on the safe side. A query that finds fewer than k codes in a part widens
it, so no query comes back short. Every row is indexed.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without an id,
take no part; a shorter vector ends in zeros; rows that repeat a vec_id are candidates of their own, but
never of queries with that id; of several query rows with one id one asks (chosen by a hash of its vector); fewer
candidates than k give them all; an empty table gives no rows. Equal vectors have equal scores, so ties are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dischargelab.llm.common import table
from dischargelab.llm.topk import best
from dischargelab.llm.vectors import BLOCK, TILE, finite_vectors, make_parts, match_tiles, matrix, query_rows, ranked

K, EVERY = 20, 20
BITS, SAMPLE, ROUNDS, HELD = 256, 4096, 10, 0.97  # HELD: share of true neighbours in the sample within the radius
PART, CHUNK, TILE_ROWS = 8192, 1024, 256


def level(x: np.ndarray, length: float) -> np.ndarray:
    """One more component, which gives every row the same length."""
    return np.c_[x, np.sqrt(np.maximum(length**2 - np.einsum("ij,ij->i", x, x), 0))]


class Coder:
    def __init__(self, sample: np.ndarray, length: float, bits: int = BITS, rounds: int = ROUNDS, seed: int = 11):
        """Rotations after which the signs of the sample lose little, one for each width's worth of bits."""
        self.length, rng = length, np.random.default_rng(seed)
        x = level(sample, length)
        self.mean = x.mean(axis=0)
        x -= self.mean
        width, turns = x.shape[1], []
        for _ in range(-(-bits // width)):
            turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
                turn = (u @ w).T
            turns.append(turn)
        self.turn = np.concatenate(turns, axis=1)[:, :bits]

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._codes(level(x, self.length))

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Only a query's direction counts: it takes the common length, and its own added component is 0."""
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return self._codes(np.c_[x * (self.length / norm)[:, None], np.zeros(len(x))])

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of bytes (a multiple of 8 of them) to one row."""
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(axis=1, dtype=np.int32)


def fit_radius(sample: np.ndarray, coder: Coder, k: int, held: float = HELD, asked: int = 128) -> int:
    codes, probes = coder.rows(sample), coder.queries(sample[:asked])
    scores = sample[:asked] @ sample.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    far = [distances(codes[n], p) for n, p in zip(near, probes, strict=True)]
    return int(np.quantile(np.concatenate(far), held)) if near.size else 8 * codes.shape[1]


class Tables:
    """A bitmap of rows for every value of every byte position, merged over the ball around the value."""

    def __init__(self, codes: np.ndarray, radius: int):
        positions = codes.shape[1]
        total = max(radius, positions - 1) - positions + 1  # so that no threshold is negative
        self.merged = []
        for j in range(positions):
            bitmap = np.packbits(codes[:, j] == np.arange(256, dtype=np.uint8)[:, None], axis=1)
            for _ in range(total // positions + (j < total % positions)):
                grown = bitmap.copy()
                for bit in range(8):
                    grown |= bitmap[np.arange(256) ^ (1 << bit)]
                bitmap = grown
            self.merged.append(bitmap)

    def probe(self, codes: np.ndarray) -> np.ndarray:
        """For each code, the bitmap of all rows that share a ball with it in some position."""
        out = self.merged[0][codes[:, 0]]
        for j, bitmap in enumerate(self.merged[1:], 1):
            out |= bitmap[codes[:, j]]
        return out


class Index:
    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, radius: int):
        self.ids, self.x, self.codes, self.radius = ids, x, codes, radius
        self.tables = Tables(codes, radius)

    def top(self, own: int, query: np.ndarray, code: np.ndarray, bitmap: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        met = np.flatnonzero(np.unpackbits(bitmap, count=len(self.ids)))
        met = met[distances(self.codes[met], code) <= self.radius]
        met = met[self.ids[met] != own]
        if len(met) < k:
            others = np.flatnonzero(self.ids != own)
            far = distances(self.codes[others], code)
            met = others[far <= np.partition(far, k - 1)[k - 1]] if len(others) > k else others
        scores = (self.x[met] * query).sum(axis=1)  # equal vectors get equal sums, whatever their row
        keep = best(self.ids[met], scores, k)
        return self.ids[met[keep]], scores[keep]


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest among all rows, by inner product."""
    rows = finite_vectors(vectors, is_query, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_parts = -(-n // PART)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    sample = matrix(drawn, width)
    coder = Coder(sample, float(np.sqrt(longest)))
    radius = fit_radius(sample, coder, k)
    coder, stride = vectors.sparkSession.sparkContext.broadcast(coder), BITS // 8  # its size depends on the width alone

    def pack(part, ids, x, asks):
        codes = coder.value.rows(x)
        out = [(part, BLOCK, i, *(a[i: i + CHUNK].tobytes() for a in (ids, x, codes))) for i in range(0, len(ids), CHUNK)]
        asked = query_rows(ids, x, asks)
        for i in range(0, len(asked), TILE_ROWS):
            at = asked[i: i + TILE_ROWS]
            out.append((part, TILE, i, ids[at].tobytes(), x[at].tobytes(), coder.value.queries(x[at]).tobytes()))
        return out

    def arrays(payload):
        ids, x, codes = payload
        return np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, width), np.frombuffer(codes, np.uint8).reshape(-1, stride)

    def build(blocks):
        return Index(*(np.concatenate(c) for c in zip(*map(arrays, blocks), strict=True)), radius)

    def score(index, tile):
        ids, x, codes = arrays(tile)
        return ids, x, [index.top(*q, k) for q in zip(ids, x, codes, index.tables.probe(codes), strict=True)]

    parts = make_parts(rows, ["vec_id"], n_parts, width, pack)
    return ranked(match_tiles(parts, n_parts, build, score), k)


def op9(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.expr(f"vec_id % {EVERY} = 0"))
