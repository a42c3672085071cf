"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find.

1. Signatures: every element of a set draws, rank by rank, a random fraction and the next register of its own random
   permutation; a register keeps the least rank + fraction. The ranks of one element are correlated (it fills each
   register once), which lowers the variance against independent hashes. A set stops as soon as every register is below
   the next rank: no element can improve it any more. Elements of all sets of a slice advance together.
2. Banding: ``BANDS`` groups of registers are hashed. Sets that share a group are candidates: at similarity 0.8 a pair is
   missed with probability (1 - 0.8 ** 4) ** 32 < 1e-7.
3. Verification on whole sets, in two passes. Every set is first held against one centre, the least key among all its
   bands' sets; components of these links label the sets. Bands that still hold several labels are then searched by
   themselves: their sets meet in blocks, where a set that has been reached leaves the search. So a group of copies
   costs little more than its size, no list of all its pairs exists, and yet no pair of a band stays untested.
4. Union-find: connected components of the verified links by rounds of small and large stars.

Equal sets collapse to one key of 128 bits first. Only sets with a partner in some band have their shingles gathered.
A centre's members and a band's blocks are dealt to cells of bounded size, so no key makes a hot task.

Defined cases: a text without words has an empty set, links with nothing and is kept; a null doc_id takes part but never
names a group (a group of null ids alone has a null one); rows that repeat a doc_id are judged by their own texts; an
empty table gives no rows; other columns are left behind. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.llm.common import map_batches, slim, table
from dischargelab.llm.components import components
from dischargelab.llm.words import mixed, runs, split_words, word_hashes
from dischargelab.session import attach, materialize, shuffle_width

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 32, 4  # registers are BANDS * ROWS, at most 256
SLICE = 1 << 20  # bytes of text at a time; a permutation takes a byte per register and word
CELL = 512  # sets of a centre, or of a block, that are searched in one cell
HOT_COPIES = 1000  # documents of one set from which on its label is broadcast
FILTER_BITS = (16, 26)  # least and most bits of the bitmap of candidates, by their logarithm


def shingle_sets(column: pa.Array, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and where each text's begin."""
    w = split_words(column)
    own = word_hashes(w)
    n_words = np.diff(w.first)
    size = np.minimum(n_words, words)  # fewer words make one shingle
    n = np.where(n_words > 0, n_words - size + 1, 0)
    at = runs(w.first[:-1], n)
    length = np.repeat(size, n)
    h = np.zeros(len(at), np.uint64)
    for j in range(words):
        there = j < length
        h[there] = mixed(h[there] * np.uint64(0x9E3779B97F4A7C15) + own[at[there] + j] + np.uint64(j + 1))
    first = np.r_[0, np.cumsum(n)]
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[s:e].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[first[:-1][n > 0]] = True
    return h[fresh], np.r_[0, np.cumsum(fresh)][first]


def signatures(h: np.ndarray, first: np.ndarray, registers: int) -> np.ndarray:
    """SuperMinHash of every set: rank << 32 | fraction per register; sets are h[first[i]:first[i + 1]] and not empty."""
    n_sets = len(first) - 1
    reg = np.full(n_sets * registers, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n_sets), np.diff(first))
    live = np.arange(len(h))
    for j in range(registers):
        x = mixed(h[live] + np.uint64(0xD1342543DE82EF95 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(registers - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = k
        else:
            place = perm[live, k].astype(np.int64)
            perm[live, k] = perm[live, j]
        np.minimum.at(reg, doc[live] * registers + place, np.uint64(j) << np.uint64(32) | x >> np.uint64(32))
        stay = (reg.reshape(n_sets, registers).max(axis=1) >= np.uint64(j + 1) << np.uint64(32))[doc[live]]
        if not stay.any():
            break
        live = live[stay]
        if j == 0:  # large sets stop at once; the others need a permutation, in which rank 0 has been swapped
            h, doc, place = h[live], doc[live], place[live]
            live = np.arange(len(h))
            perm = np.tile(np.arange(registers, dtype=np.uint8), (len(h), 1))
            perm[live, place] = 0
    return reg.reshape(n_sets, registers)


def set_keys(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits of every set that is not empty: two sums of mixed hashes."""
    sums = np.stack([np.add.reduceat(mixed(h ^ np.uint64(s)), first[:-1]) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)
    flat = mixed(sums + np.diff(first).astype(np.uint64)[:, None]).astype(">u8").tobytes()
    return [flat[i: i + 16] for i in range(0, len(flat), 16)]


SIGNED = "doc_id long, key binary, n_shingles long, bands array<long>"


def signed_documents(docs: DataFrame, words: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, bands) of every row; key and bands are null where the set is empty."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first = shingle_sets(batch.column("text"), words)
        n = np.diff(first)
        some = n > 0
        keys, hashed = np.full(len(n), None, object), np.zeros((len(n), bands), np.int64)
        if some.any():
            edge = np.r_[0, np.cumsum(n[some])]
            keys[some] = set_keys(h, edge)
            reg = signatures(h, edge, bands * rows).reshape(-1, bands, rows)
            band = np.broadcast_to(np.arange(bands, dtype=np.uint64), reg.shape[:2]).copy()
            for i in range(rows):
                band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + reg[:, :, i])
            hashed[some] = band.view(np.int64)
        offsets = np.r_[0, np.cumsum(np.where(some, bands, 0))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed[some].ravel()))
        return pa.record_batch({"doc_id": batch.column("doc_id"), "key": pa.array(keys.tolist(), pa.binary()),
                                "n_shingles": pa.array(n.astype(np.int64)), "bands": lists})

    return map_batches(slim(docs, id_col, text_col), kernel, SIGNED, limit=SLICE)


def bitmap(keys: DataFrame, col: str) -> np.ndarray:
    """A bitmap of the hashes in ``col``, 16 bits for each up to a fixed size (8 MB); beyond it more false positives pass."""
    bits = int(np.clip((16 * keys.count()).bit_length(), *FILTER_BITS))
    bit = keys.select(F.shiftrightunsigned(col, 64 - bits).alias("bit"))
    words = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes.view(np.uint64) >> np.uint64(64 - (len(bits).bit_length() + 5))
    return bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) == 1


def candidate_sets(texts: DataFrame, wanted: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(sid, shingles): whole sets of the wanted keys (sid, key, row_hash); row_hash is of a document that has the set."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, "row_hash"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(held(sent.value, batch.column("row_hash").to_numpy())))
        h, first = shingle_sets(batch.column("text"), words)
        some = np.flatnonzero(np.diff(first))
        keys = set_keys(h, np.r_[first[some], len(h)]) if len(some) else []
        own = [h[first[i]: first[i + 1]].tobytes() for i in some]
        return pa.record_batch({"key": pa.array(keys, pa.binary()), "shingles": pa.array(own, pa.binary())})

    found = map_batches(texts.select("text", F.xxhash64("doc_id").alias("row_hash")), kernel, "key binary, shingles binary", limit=SLICE)
    return found.join(wanted.select("key", "sid"), "key").dropDuplicates(["sid"]).select("sid", "shingles")


class Postings:
    """Sets of a cell with an inverted index."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        h = np.concatenate(sets)
        order = np.argsort(h, kind="stable")
        self.owner, self.sets = owner[order], sets
        self.values, start = np.unique(h[order], return_index=True)
        self.start = np.r_[start, len(h)]

    def linked(self, i: int, percent: int) -> np.ndarray:
        """Which sets are within the similarity of set i, by their whole intersections."""
        at = np.searchsorted(self.values, self.sets[i])
        met = self.owner[runs(self.start[at], self.start[at + 1] - self.start[at])]
        both = np.bincount(met, minlength=len(self.size))
        return 100 * both >= percent * (self.size + self.size[i] - both)


def spanning(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets; a set that has been reached is not compared again."""
    index, left, links = Postings(sets), np.ones(len(sets), bool), []
    for i in range(len(sets)):
        reached = [i] if left[i] else []
        left[i] = False
        while reached and left.any():
            x = reached.pop()
            found = np.flatnonzero(index.linked(x, percent) & left)
            left[found] = False
            links += [(x, int(y)) for y in found]
            reached += found.tolist()
    return links


def grouped(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[pa.Table]:
    """Rows of one value of ``col`` after the other; rows arrive sorted by it."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(col).to_numpy()
        edge = np.r_[0, np.flatnonzero(v[1:] != v[:-1]) + 1, len(v)].tolist()
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if rest and rest[0].column(col)[0].as_py() != v[s]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(b.slice(s, e - s))
    if rest:
        yield pa.Table.from_batches(rest)


LINKS = "a long, b long"


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def star_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): verified links of every member (sid, centre, n) with its centre.

    A centre's members are dealt to parts by ``n``, the size of a band that they share with it, and each part has the
    centre's set at its head.
    """
    dealt = members.select("sid", "centre", F.expr(f"cast(pmod(xxhash64(sid), (n - 1) div {CELL} + 1) AS int)").alias("part"), F.lit(1).alias("turn"))
    heads = dealt.select(F.col("centre").alias("sid"), "centre", "part", F.lit(0).alias("turn")).distinct()
    both = dealt.unionByName(heads).join(sets, "sid").withColumn("cell", F.xxhash64("centre", "part"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for b in batches:
            out = []
            for name, own, turn, shingles in zip(*(b.column(c).to_pylist() for c in ("centre", "sid", "turn", "shingles")), strict=True):
                s = np.frombuffer(shingles, np.uint64)
                if turn == 0:
                    centre = s
                    continue
                at = np.searchsorted(centre, s)
                same = int((centre[np.minimum(at, len(centre) - 1)] == s).sum())
                if 100 * same >= percent * (len(s) + len(centre) - same):
                    out.append((name, own))
            yield _links(out)

    rows = both.select("cell", "centre", "part", "turn", "sid", "shingles").repartition(shuffle_width(sets.sparkSession), "cell")
    return rows.sortWithinPartitions("cell", "centre", "part", "turn").mapInArrow(kernel, LINKS)


def band_links(rows: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): verified links that connect the sets of every band (band, sid, root, weight), of whose sets those with one
    root are connected already.

    Sets are dealt to blocks of about CELL units of weight. A root with more than that has blocks of its own, and two of
    them never meet; all others share mixed blocks. Every other two blocks of a band meet in a cell.
    """
    rows = rows.join(rows.groupBy("band", "root").agg(F.sum("weight").alias("own")), ["band", "root"])
    small = F.when(F.col("own") <= CELL, F.col("weight"))
    rows = rows.join(rows.groupBy("band").agg(F.coalesce(F.sum(small), F.lit(0)).alias("mixed")), "band")
    rows = rows.select("band", "sid", F.expr(f"CASE WHEN own > {CELL} THEN root ELSE -1 END").alias("owner"), F.expr(
        f"CASE WHEN own > {CELL} THEN pmod(xxhash64(sid), (own - 1) div {CELL} + 1) ELSE pmod(xxhash64(root), (mixed - 1) div {CELL} + 1) END").alias("block"))
    blocks = rows.select("band", "owner", "block").distinct()
    other = blocks.select("band", F.col("owner").alias("owner2"), F.col("block").alias("block2"))
    met = blocks.join(other, "band").where("owner < owner2 OR owner = -1 AND owner2 = -1 AND block <= block2").withColumn(
        "cell", F.xxhash64("band", "owner", "block", "owner2", "block2"))
    sides = met.select("band", "owner", "block", "cell").unionByName(
        met.select("band", F.col("owner2").alias("owner"), F.col("block2").alias("block"), "cell")).distinct()
    tiles = rows.join(sides, ["band", "owner", "block"]).select("cell", "sid")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, "cell"):
            own = cell.column("sid").to_pylist()
            found = spanning([np.frombuffer(s, np.uint64) for s in cell.column("shingles").to_pylist()], percent)
            if found:
                yield _links([(own[x], own[y]) for x, y in found])

    dealt = tiles.join(sets, "sid").select("cell", "sid", "shingles").repartition(shuffle_width(sets.sparkSession), "cell")
    return dealt.sortWithinPartitions("cell").mapInArrow(kernel, LINKS)


def verified_links(banded: DataFrame, named: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links that connect all sets (sid, key, least, n_shingles) within the similarity that share a band (sid, band)."""
    heads = banded.groupBy("band").agg(F.min("sid").alias("head"), F.count("*").alias("n")).where("n > 1")  # alone in a band: no candidates
    rows = materialize(banded.join(heads, "band").select("band", "sid", "head", "n"))
    centres = rows.groupBy("sid").agg(F.min(F.struct("head", "n")).alias("c")).select("sid", F.col("c.head").alias("centre"), "c.n")
    about = named.select("sid", "key", F.xxhash64("least").alias("row_hash"), F.expr("n_shingles div 512 + 1").alias("weight"))
    centres = materialize(centres.join(about, "sid"))
    sets = materialize(candidate_sets(texts, centres, words))
    stars = materialize(star_links(centres.where("sid <> centre").select("sid", "centre", "n"), sets, percent))

    label = components(stars).withColumnRenamed("v", "sid")
    about = materialize(centres.join(label, "sid", "left").select("sid", "centre", "weight", F.coalesce("root", "sid").alias("root")))
    labelled = rows.join(about, "sid")
    tested = F.expr("n = 2 AND (sid = head OR centre = head)")
    left = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.expr("bit_xor(xxhash64(sid))").alias("who"),
                                        F.count("*").alias("n_sets"), F.min(tested).alias("tested")).where("low <> high AND NOT tested")
    once = left.groupBy("who", "n_sets").agg(F.min("band").alias("band"))  # bands of the same sets are searched once
    more = band_links(labelled.join(once.select("band"), "band", "left_semi").select("band", "sid", "root", "weight"), sets, percent)
    return stars.unionByName(materialize(more))


def near_groups(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    texts = slim(docs, id_col, text_col)
    own = materialize(signed_documents(texts, words, bands, rows))
    named = materialize(own.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")).withColumn(
        "sid", F.monotonically_increasing_id()))
    group = components(verified_links(named.select("sid", F.explode("bands").alias("band")), named, texts, words, percent)).withColumnRenamed("v", "sid")
    rooted = materialize(named.select("sid", "key", "least", "copies").join(group, "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialize(rooted.join(names, "root").select("key", "copies", "component_id"))

    # Sets of many copies are few, at most rows / HOT_COPIES; their rows and those without words need no shuffle.
    often = labels.where(F.col("copies") >= HOT_COPIES).select("key", F.col("component_id").alias("often_id"), F.lit(True).alias("often"))
    own = attach(own.select("doc_id", "key", "n_shingles"), often, ["key"], "left")
    done = own.where("often OR key IS NULL").select("doc_id", "n_shingles", F.expr("if(key IS NULL, doc_id, often_id)").alias("component_id"))
    rest = own.where("often IS NULL AND key IS NOT NULL").join(labels, "key").select("doc_id", "n_shingles", "component_id")
    return done.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-
]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, CAST(greatest(2, len(words) - 2) AS BIGINT)),
    lambda i: array_to_string(words[i:i + 3], ' '))) AS shingle FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * same >= 80 * (na.n + nb.n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v WHERE r.root < e.b),
c AS (SELECT v, min(root) AS root FROM r GROUP BY v)
SELECT v AS doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, v = root AS kept FROM c LEFT JOIN n ON n.doc_id = v
"""
