"""Alignment of two tokenizers by pointer jumping.

Both token streams of a text cover the same bytes. Every token points to its farthest-right overlapping token,
which is the other stream's token that holds its last byte. Where both streams end a token at the same byte, the token of
stream A points to itself and that of B to it. Successors are doubled (p = p[p]) for the whole batch at once until
nothing changes; then every token points to the terminal token of its component, which labels its group. The
number of rounds is the logarithm of the longest group.

How often an id pair is linked over the corpus is counted per slice of text, combined map-side and summed by pair. The
counts go back to the documents in two ways that agree: the most frequent pairs, at most ``SENT_PAIRS`` of them, are
broadcast; the links of all other pairs are summed per row and pair and meet their counts in a join.

Stream A is a byte-level BPE file of the tokenizers library. Its pattern and merges are run by tiktoken, six times as fast,
for texts whose characters have been in the same class since Unicode 3.2; other texts go to the library itself.

Defined cases: null and empty texts, and those whose streams do not spell a space and the text (B normalises some
characters), have no tokens and zeros everywhere; repeated and null ids are rows of their own; an empty table gives no
rows; other columns are left behind. A text is never parted: memory is some multiple of the longest one.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dischargelab.llm.common import map_batches, slim, table
from dischargelab.session import materialize

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SENT_PAIRS = 1_000_000  # pairs whose counts are broadcast: at most 12 MB
SLICE = 1 << 20  # bytes of text that are aligned at a time


@functools.lru_cache(maxsize=65536)
def settled(ch: str) -> bool:
    """The character's class is the same in all Unicode versions since 3.2."""
    old = unicodedata.ucd_3_2_0.category(ch)
    return old != "Cn" and old == unicodedata.category(ch)


class ByteStream:
    """Ids and bytes of a byte-level BPE."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # Printable bytes stand for themselves, the others for the characters from 256 on, in order.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.bytes_of = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        special = set(self.tokenizer.get_added_tokens_decoder())
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [model["vocab"][t] for t in merged]
        # Ranks may stand in for merges where ids grow in merge order.
        self.fast = None
        if all(x < y for x, y in zip(ids, ids[1:])):
            ranks = {self.bytes_of[i]: i for i in model["vocab"].values() if i not in special}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and (text.isascii() or all(map(settled, set(text)))):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class PieceStream:
    """Ids and bytes of a sentencepiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes_of = [bytes([int(self.model.id_to_piece(i)[1:-1], 16)]) if self.model.is_byte(i)
                         else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def streams(byte_path: str, pattern: str, piece_path: str) -> tuple[ByteStream, PieceStream]:
    return ByteStream(byte_path, pattern), PieceStream(piece_path)


def spelled(ids: list[int], bytes_of: list[bytes]) -> bytes:
    return b"".join(map(bytes_of.__getitem__, ids))


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal token of each A and B token's component, as the number of an A token. Both streams cover the same bytes."""
    n = len(end_a)
    over_b, over_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)  # who holds the last byte
    cut = end_b[over_b] == end_a if n else end_a == end_a
    succ = np.r_[np.where(cut, np.arange(n), n + over_b), over_a]
    while True:
        doubled = succ[succ]
        if np.array_equal(doubled, succ):
            return succ[:n], succ[n:]
        succ = doubled


@functools.lru_cache(maxsize=1)
def written(n: int) -> list[str]:
    """Decimal ids, each with all three marks behind it."""
    return [f"{i}{mark}" for i in range(n) for mark in ",|;"]


def aligned(ids_a: list[list[int]], ids_b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray) -> dict[str, list]:
    """Per text: the groups as a digest, their number, and the linked id pairs (a << 32 | b)."""
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    root_a, root_b = terminals(end_a, end_b)
    # Groups in order; in each, A's tokens come before B's.
    last_a = np.flatnonzero(root_a == np.arange(len(a)))  # terminal tokens
    group_a, group_b = np.searchsorted(last_a, root_a), np.searchsorted(last_a, root_b)
    last_b = np.searchsorted(group_b, np.arange(len(last_a)), side="right") - 1
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 2
    line = np.zeros(len(a) + len(b), np.int64)
    line[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = 3 * a + mark_a
    line[np.arange(len(b)) + (last_a + 1)[group_b]] = 3 * b + mark_b
    text = written(int(max(len(size_a), len(size_b))))
    pair = a[last_a] << 32 | b[last_b]
    out = {"n_groups": [], "links": [], "groups_sha256": []}
    at = group = 0
    marks = list(map(text.__getitem__, line.tolist()))
    stops = np.searchsorted(last_a, np.cumsum(n_a)).tolist()
    for x, y, stop in zip(n_a.tolist(), n_b.tolist(), stops, strict=True):
        own = "".join(marks[at: at + x + y])[:-1]
        out["groups_sha256"].append(hashlib.sha256(own.encode()).hexdigest() if own else "")
        out["n_groups"].append(stop - group)
        out["links"].append(pair[group:stop].astype("<i8").tobytes())
        at, group = at + x + y, stop
    return out | {"n_a": n_a, "n_b": n_b}


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, links binary, groups_sha256 string"


def align_documents(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, links, groups_sha256) of every row; links are packed 64-bit id pairs, a above b."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        byte, piece = streams(byte_path, pattern, piece_path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids_a, ids_b = [byte.encode(f" {t}") if t else [] for t in texts], piece.encode_all(texts)
        for i, t in enumerate(texts):
            whole = f" {t}".encode()
            if not t or spelled(ids_b[i], piece.bytes_of) != whole or spelled(ids_a[i], byte.bytes_of) != whole:
                ids_a[i], ids_b[i] = [], []
        size_a, size_b = (np.array([len(x) for x in s.bytes_of], np.int64) for s in (byte, piece))
        cols = aligned(ids_a, ids_b, size_a, size_b)
        return pa.record_batch({"doc_id": batch.column("doc_id"), "n_a": pa.array(cols["n_a"]), "n_b": pa.array(cols["n_b"]),
                                "n_groups": pa.array(cols["n_groups"], pa.int64()), "links": pa.array(cols["links"], pa.binary()),
                                "groups_sha256": pa.array(cols["groups_sha256"], pa.string())})

    return map_batches(slim(docs, id_col, text_col), kernel, ALIGNED, limit=SLICE)


def flat_links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch and the row of each."""
    lists = batch.column("links").to_pylist()
    return np.frombuffer(b"".join(lists), "<i8"), np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists])


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, n, best): links of every id pair over the corpus, and the highest count of the pair's B id."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair, n = np.unique(flat_links(batch)[0], return_counts=True)
        return pa.record_batch({"pair": pa.array(pair, pa.int64()), "n": pa.array(n, pa.int64())})

    each = map_batches(made.select("links"), kernel, "pair long, n long", "links")
    total = materialize(each.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.expr("pair & 4294967295")))
    return total.join(total.groupBy("b").agg(F.max("n").alias("best")), "b").select("pair", "n", "best")


def frequent(counts: DataFrame, limit: int) -> tuple[int, bool]:
    """The least count n such that at most ``limit`` pairs have it or a higher one, and whether other pairs remain."""
    sizes = counts.groupBy(F.length(F.bin("n")).alias("bits")).count().orderBy(F.desc("bits")).collect()  # at most 63 rows
    held, least = 0, 1 << 62
    for r in sizes:
        held += r["count"]
        if held > limit:
            return least, True
        least = 1 << r["bits"] - 1
    return 0, False


def link_statistics(made: DataFrame, limit: int = SENT_PAIRS) -> DataFrame:
    """Replaces ``links`` by n_links, n_best and count_sum."""
    made = materialize(made.withColumn("row", F.monotonically_increasing_id()))
    counts = materialize(pair_counts(made))
    least, more = frequent(counts, limit)
    top = counts.where(F.col("n") >= least).sort("pair").toArrow()
    table = tuple(top.column(c).to_numpy() for c in ("pair", "n")) + (np.equal(top.column("n"), top.column("best")),)
    sent = made.sparkSession.sparkContext.broadcast(table)

    def found(batch: pa.RecordBatch):
        pair, n, best = sent.value
        links, row = flat_links(batch)
        at = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
        known = pair[at] == links if len(pair) else np.zeros(len(links), bool)
        return links, row, known, np.where(known, n[at], 0) if len(pair) else known.astype(np.int64), best[at] & known if len(pair) else known

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        links, row, known, n, best = found(batch)
        size = batch.num_rows
        edge = np.searchsorted(row, np.arange(size + 1))
        total, top_n = (np.r_[0, np.cumsum(x.astype(np.int64))] for x in (n, best))
        keep = [c for c in batch.schema.names if c != "links"]
        cols = {c: batch.column(c) for c in keep} | {"n_links": pa.array(np.diff(edge)), "n_best": pa.array(np.diff(top_n[edge])),
                                                     "count_sum": pa.array(np.diff(total[edge]))}
        return pa.record_batch(cols)

    def others(batch: pa.RecordBatch) -> pa.RecordBatch:
        links, row, known, _, _ = found(batch)
        rare, times = np.unique(np.stack([row[~known], links[~known]]), axis=1, return_counts=True)
        return pa.record_batch({"row": batch.column("row").take(pa.array(rare[0])), "pair": pa.array(rare[1], pa.int64()), "times": pa.array(times, pa.int64())})

    out = map_batches(made, kernel, ALIGNED.replace("links binary, ", "") + ", row long, n_links long, n_best long, count_sum long", "links")
    if more:
        rows = map_batches(made.select("row", "links"), others, "row long, pair long, times long", "links")
        added = rows.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(
            F.sum(F.expr("times * n")).alias("more_sum"), F.sum(F.expr("CASE WHEN n = best THEN times ELSE 0 END")).alias("more_best"))
        out = out.join(added, "row", "left").withColumn("n_best", F.expr("n_best + coalesce(more_best, 0)")).withColumn(
            "count_sum", F.expr("count_sum + coalesce(more_sum, 0)"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return link_statistics(align_documents(table(spark, sf_dir, "documents"), str(tokenizers.path(BYTE_BPE)), tokenizers.PATTERN,
                                           str(tokenizers.path(PIECE_BPE))))
