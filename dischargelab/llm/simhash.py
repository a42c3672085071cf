"""SimHash near-duplicates with multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most ``radius`` bits, then in some
segment they differ in no more bits than its threshold (the thresholds sum to radius - segments + 1), so
one of them lies in the small Hamming ball around the other's segment. Every distinct fingerprint
stands in a table under its segment values and probes the tables with the other values of its balls;
what meets under a value is verified on all 64 bits.

* Copies collapse first: tables hold distinct fingerprints.
* Rows of a value arrive sorted and are streamed. Few rows are compared pair by pair. Many (a large
  group of near copies) are searched from one fingerprint to the next, and what is found leaves the
  search, so such a group costs little more than its size and hands on a spanning tree, not all pairs.
* Groups are the connected components of the verified links.

Defined cases: a null or empty text, or one of white space alone, has fingerprint zero, which links like
any other; a null doc_id takes part but never names a group (a group of null ids alone has a null one);
rows that repeat a doc_id are one document; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dischargelab.llm.common import map_batches, slim, table
from dischargelab.llm.components import components
from dischargelab.llm.minhash import SLICE, set_keys, shingle_sets, verified_links
from dischargelab.llm.words import mixed
from dischargelab.session import materialize, shuffle_width

SHINGLE, SEED, RADIUS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 22), (44, 20))  # shift, width
FEW_PAIRS = 64  # candidate pairs of a value that are compared one by one


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    found = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return 0
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    whole = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(whole, seed)]
    else:
        starts = [0] + [e + 1 for e in ends[: len(ends) - words]]
        xxh = xxhash.xxh64_intdigest
        hashes = [xxh(whole[s:e], seed) for s, e in zip(starts, ends[words - 1:], strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(majority, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(own, pa.int64())})

    return map_batches(slim(docs, id_col, text_col), kernel, "doc_id long, fp long")


def thresholds(segments: int, radius: int) -> list[int]:
    """Segment thresholds that sum to radius - segments + 1, as even as can be."""
    total = radius - segments + 1
    return [total // segments + (i < total % segments) for i in range(segments)]


def ball(width: int, reach: int) -> list[int]:
    """All masks of at most ``reach`` set bits."""
    masks = [0]
    for _ in range(reach):
        masks = sorted({m | 1 << b for m in masks for b in range(width)} | set(masks))
    return masks


def _tables(fps: DataFrame, segments, radius: int) -> DataFrame:
    """(slot, probe, fp): a fingerprint under its own segment values, and as a probe under the others of its balls."""
    slots = []
    for i, ((shift, width), reach) in enumerate(zip(segments, thresholds(len(segments), radius), strict=True)):
        if reach >= 0:
            own = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
            slots += [F.struct((own.bitwiseXOR(F.lit(m)) + F.lit(i << 40)).alias("slot"), F.lit(m != 0).alias("probe")) for m in ball(width, reach)]
    return fps.select("fp", F.explode(F.array(*slots)).alias("s")).select("s.slot", "s.probe", "fp")


def near(x: np.ndarray, y, radius: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= radius  # of a signed number it would count the bits of its absolute value


def spanning(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within ``fps``: what has been reached is not compared again."""
    left, links = np.unique(fps), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            hit = near(left, x, radius)
            if hit.any():
                found, left = left[hit], left[~hit]
                links.append((np.full(len(found), x), found))
                reached.extend(found)
    return links


def links_of(slot: np.ndarray, probe: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows sorted by slot."""
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    sizes = np.diff(np.r_[starts, len(slot)])
    in_table = np.add.reduceat((~probe).astype(np.int64), starts)
    pairs = in_table * sizes
    few = np.repeat((pairs <= FEW_PAIRS) & (in_table > 0) & (sizes > 1), sizes) & ~probe
    rows = np.flatnonzero(few)
    group = np.repeat(np.arange(len(starts)), sizes)[rows]
    n = sizes[group]
    x = np.repeat(fp[rows], n)
    y = fp[np.repeat(starts[group], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    ok = (x != y) & near(x, y, radius)
    links = [(x[ok], y[ok])]
    for g in np.flatnonzero(pairs > FEW_PAIRS):
        links += spanning(fp[starts[g]: starts[g] + sizes[g]], radius)
    return np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])


def linked(fps: DataFrame, segments=SEGMENTS, radius: int = RADIUS) -> DataFrame:
    """(a, b): verified links that connect all distinct fingerprints (column fp) within ``radius`` of each other."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(*cols):
            a, b = links_of(*cols, radius)
            return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

        rest = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "probe", "fp")]
            cols = cols if rest is None else [np.concatenate(c) for c in zip(rest, cols, strict=True)]
            last = np.searchsorted(cols[0], cols[0][-1])  # the last slot may go on in the next batch
            if last:
                yield out(*(c[:last] for c in cols))
            rest = [c[last:] for c in cols]
        if rest is not None and len(rest[0]):
            yield out(*rest)

    n = shuffle_width(fps.sparkSession)
    tables = _tables(fps, segments, radius).repartition(n, "slot").sortWithinPartitions("slot")
    return tables.mapInArrow(stream, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links reach, itself included."""
    own = materialize(fingerprints(docs, id_col, text_col))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    group = components(linked(distinct.select("fp"), radius=radius))
    rooted = distinct.join(group.withColumnRenamed("v", "fp"), "fp").select("fp", "root", "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = distinct.join(rooted.select("fp", "root").join(named, "root"), "fp", "left").select(
        "fp", F.least("component_id", "least").alias("component_id"))
    labels = materialize(labels)  # so that the join below shuffles both sides itself and AQE can split a hot fingerprint
    return own.join(labels, "fp").select("doc_id", "fp", "component_id")


# Near copies by shingles: fingerprints of 128 bits in eight segments. At a similarity of 0.8 about 15 % of the bits differ; then
# some segment differs in at most one bit with probability 0.93 (0.996 at 0.9), and the whole in at most REACH with 0.999.
WIDE, REACH, WORDS, PERCENT = 16, 32, 5, 80


def wide_fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 majority bits, as two integers, of every set h[first[i]:first[i + 1]]; sets are not empty."""
    wide = np.stack([mixed(h ^ np.uint64(0xA0761D6478BD642F)), mixed(h ^ np.uint64(0xE7037ED1A0B428DB))], axis=1)
    bits = np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    on = np.add.reduceat(bits, first[:-1], axis=0, dtype=np.int32)
    return np.packbits(on * 2 > np.diff(first)[:, None], axis=1, bitorder="little").view("<i8")


def set_fingerprints(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, row_key, key, n_shingles, lo, hi) of every row; null key where the text has no words."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first = shingle_sets(batch.column("text"), words)
        n = np.diff(first)
        some = n > 0
        keys, fp = np.full(len(n), None, object), np.zeros((len(n), 2), np.int64)
        if some.any():
            edge = np.r_[0, np.cumsum(n[some])]
            keys[some], fp[some] = set_keys(h, edge), wide_fingerprints(h, edge)
        return pa.record_batch({"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "key": pa.array(keys.tolist(), pa.binary()),
                                "n_shingles": pa.array(n.astype(np.int64)), "lo": pa.array(fp[:, 0]), "hi": pa.array(fp[:, 1])})

    return map_batches(texts, kernel, "doc_id long, row_key long, key binary, n_shingles long, lo long, hi long", limit=SLICE)


def close_pairs(sets: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b): links that connect sets (sid, lo, hi) that share a ball in a segment and differ in at most ``reach`` bits."""
    slots = []
    for i in range(128 // WIDE):
        own = F.shiftrightunsigned("lo" if i * WIDE < 64 else "hi", i * WIDE % 64).bitwiseAND(F.lit((1 << WIDE) - 1))
        slots += [F.struct((own.bitwiseXOR(F.lit(m)) + F.lit(i << 40)).alias("slot"), F.lit(m != 0).alias("probe")) for m in ball(WIDE, 1)]
    rows = sets.select("sid", "lo", "hi", F.explode(F.array(*slots)).alias("s")).select("sid", "s.slot", "s.probe", "lo", "hi")

    def search(sid, probe, fp):
        """Each set of the table, from the first on, takes what is near it out of the search, table and probes alike."""
        left = np.ones(len(sid), bool)
        out = []
        for i in np.flatnonzero(~probe):
            if not left[i]:
                continue
            reached, left[i] = [i], False
            while reached:
                x = reached.pop()
                met = np.flatnonzero(left)
                met = met[np.bitwise_count((fp[met] ^ fp[x]).view(np.uint64)).sum(axis=1) <= reach]
                left[met] = False
                out += [(sid[x], sid[y]) for y in met]
                reached += met.tolist()
        return out

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if rest is None:
                    break
                cols, last = rest, len(rest[0])
            else:
                if not batch.num_rows:
                    continue
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "sid", "probe", "lo", "hi")]
                cols = cols if rest is None else [np.concatenate(c) for c in zip(rest, cols, strict=True)]
                last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last slot may go on in the next batch
            slot, sid, probe = (c[:last] for c in cols[:3])
            fp = np.stack([cols[3][:last], cols[4][:last]], axis=1)
            edge = np.r_[0, np.flatnonzero(slot[1:] != slot[:-1]) + 1, last] if last else np.zeros(1, np.int64)
            out = [p for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if e - s > 1 for p in search(sid[s:e], probe[s:e], fp[s:e])]
            yield pa.record_batch({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
            rest = [c[last:] for c in cols]

    n = shuffle_width(sets.sparkSession)
    return rows.repartition(n, "slot").sortWithinPartitions("slot", "probe").mapInArrow(kernel, "a long, b long")


def copy_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, copies, chosen): of every different row, by the hash of all its columns, how often it stands there, and the row_key
    that stands for its group.

    Groups of fingerprints within reach are candidates; their whole shingle sets are compared, as in minhash.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("row_key"))
    own = materialize(set_fingerprints(texts, words))
    named = materialize(own.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n_shingles", "lo", "hi")]).withColumn("sid", F.monotonically_increasing_id()))
    close = components(close_pairs(named.select("sid", "lo", "hi"))).select(F.col("v").alias("sid"), F.col("root").alias("band"))
    links = verified_links(materialize(close), named, texts.select("doc_id", "text"), words, percent)
    group = components(links).withColumnRenamed("v", "sid")
    label = materialize(named.select("sid", "key").join(group, "sid", "left").select("key", F.coalesce("root", "sid").alias("root")))
    # Texts without words are one group of their own kind: each stays.
    rows = own.groupBy("row_key", "key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    rows = materialize(rows.join(label, "key", "left"))
    first = rows.where("root IS NOT NULL").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("f")).select("root", F.col("f.row_key").alias("chosen"))
    return rows.join(first, "root", "left").select("row_key", "copies", F.coalesce("chosen", "row_key").alias("chosen"), F.col("key").isNull().alias("blank"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of near copies, all columns kept: the one with the smallest doc_id (a null one last), of several the
    one with the least hash of all its columns. Rows that are equal in all columns are one. Texts without words all stay."""
    groups = copy_groups(docs, words, percent, id_col, text_col)
    known = materialize(groups.where("NOT blank AND (row_key <> chosen OR copies > 1)").select(
        F.col("row_key").alias("_row_key"), (F.col("row_key") == F.col("chosen")).alias("_stays")))
    marked = docs.withColumn("_row_key", F.xxhash64(*[docs[c] for c in docs.columns])).join(known.hint("shuffle_hash"), "_row_key", "left")
    once = marked.where("_stays").dropDuplicates(["_row_key"])
    return marked.where("_stays IS NULL").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
