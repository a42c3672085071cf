"""Harmonic packing of token streams into sequences of fixed capacity.

A document's ids are cut into whole sequences first; what remains is cut at reciprocals of the
capacity C: the largest C div k that fits, then the rest, until at most ``UNCUT`` ids are left. A piece
of length L belongs to class k = C div L, and a sequence takes exactly k pieces of class k. So a worker
fills the sequences of its classes by counting, without looking at any other worker.

Workers are hash buckets of pieces. Each (class, bucket) fills whole sequences; its fewer than k pieces
left over meet those of other buckets at the next, coarser level, down to one bucket per class. What is
left then, fewer than k pieces per class whatever the input, is packed by first-fit decreasing.

Ids are those of the tokenizer as its file sets it up: strings of special tokens in a text become those tokens.

Defined cases: a null or empty text is one piece that holds the end id alone; rows that repeat a doc_id
(or a null one) are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import string
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.llm.common import map_batches, slim, table
from dischargelab.session import materialize

CAPACITY, UNCUT, END_ID = 2048, 128, 1
LEVELS = (1024, 64, 8, 1)  # buckets per class, from fine to coarse; at most 2 ** 10 of them and 8 levels
CACHED_WORDS = 300_000
SLICE = 2 << 20  # bytes of text that are worked on at a time; lists of words take some ten times as much
GROUP = 200  # words that are encoded as one text
END = "\n"  # stands for the end id: a line feed is in no word
MODEL = "word_bpe_49k.json"
MARKS = string.punctuation.replace("'", "")  # an apostrophe may begin a match with letters


class Numbered(dict):
    """Numbers words as they are first asked for; ``fresh`` lists those without ids yet, in order."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordIds:
    """Ids of space-separated words. The tokenizer drops white space and no match crosses it, so a text's ids are its words' ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Lower-case words of letters up to U+00FF are left as they are by the normalizer and match as a whole: spaces alone part them.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # matched before lower-casing
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.known = Numbered()
        self.known[END] = 0
        self.starts, self.sizes, self.pool = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([END_ID], "<u4")

    def encode(self, texts: list[str], plain: bool = False) -> list[np.ndarray]:
        tokenizer = self.plain if plain else self.tokenizer
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self) -> None:
        """Ids of the fresh words. Words of letters are encoded many at a time and told apart by their
        end tokens; letters with a run of marks behind are two matches, so they take the ids of both."""
        plain, letters, other, marked = [], [], [], []
        for w in self.known.fresh:  # which grows by the parts of marked words
            head = w.rstrip(MARKS)
            if w.isalpha():
                (plain if w == w.lower() and max(w) <= "\xff" else letters).append(w)
            elif len(head) < len(w) and head.lower().isalpha():
                marked.append((self.known[w], self.known[head], self.known[w[len(head):]]))
            else:
                other.append(w)
        at, sizes, ids = [], [], []
        for words in (plain, letters):
            groups = [words[i: i + GROUP] for i in range(0, len(words), GROUP)]
            for group, encoded in zip(groups, self.encode([" ".join(g) for g in groups], words is plain), strict=True):
                stops = np.flatnonzero(self.ends[encoded]) + 1
                if len(stops) == len(group):  # one match per word, as its letters stay letters
                    at += map(self.known.__getitem__, group)
                    sizes.append(np.diff(stops, prepend=0))
                    ids.append(encoded)
                else:
                    other += group
        at += map(self.known.__getitem__, other)
        ids += self.encode(other)
        sizes.append(np.array([len(x) for x in ids[len(ids) - len(other):]], np.int64))
        self.place(np.array(at, np.int64), np.concatenate(sizes), np.concatenate([*ids, self.pool[:0]]))
        if marked:
            whole, parts = np.array(marked)[:, 0], np.array(marked)[:, 1:]
            own = self.pool[spread(self.starts[parts.ravel()], self.sizes[parts.ravel()])]
            self.place(whole, self.sizes[parts].sum(axis=1), own)
        self.known.fresh = []

    def place(self, at: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        more = np.zeros(len(self.known) - len(self.sizes), np.int64)
        self.starts, self.sizes = np.append(self.starts, more), np.append(self.sizes, more)
        self.starts[at], self.sizes[at] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
        self.pool = np.append(self.pool, ids)

    def stream(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end id after each text, and the number of ids of each text."""
        if len(self.known) > CACHED_WORDS:
            self.reset()
        words: list[str] = []
        counts = []
        for t in texts:
            own = self.words(t or "")
            own.append(END)
            words += own
            counts.append(len(own))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.fresh:
            self.learn()
        sizes = self.sizes[at]
        stops = np.cumsum(sizes)[np.cumsum(counts) - 1]
        return self.pool[spread(self.starts[at], sizes)], np.diff(stops, prepend=0)

    def words(self, text: str) -> list[str]:
        """Lower-casing first, where it can't differ from the tokenizer's own, makes for fewer words."""
        try:
            text.isascii() or text.encode("latin-1")
            low = text.lower()
            text = text if any(t in low for t in self.special) else low
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@functools.lru_cache(maxsize=65536)
def cuts(n: int, capacity: int = CAPACITY, uncut: int = UNCUT) -> tuple[int, ...]:
    """Lengths of the pieces of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > uncut:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return tuple(out + [rest] * (rest > 0))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Pieces of every row; ``keep_ids`` adds their ids (little-endian unsigned 32-bit integers)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, sizes = word_ids(path).stream(batch.column("text").to_pylist())
        row, start, length, crc, own, at = [], [], [], [], [], 0
        for i, n in enumerate(sizes.tolist()):
            begin = at
            for size in cuts(n, capacity):
                piece = flat[at: at + size].tobytes()
                row.append(i)
                start.append(at - begin)
                length.append(size)
                crc.append(zlib.crc32(piece))
                if keep_ids:
                    own.append(piece)
                at += size
        cols = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(sizes[row], pa.int64())}
        return pa.record_batch(cols | ({"ids": pa.array(own, pa.binary())} if keep_ids else {}))

    return map_batches(slim(docs, id_col, text_col), kernel, PIECES + ", ids binary" * keep_ids, limit=SLICE)


def first_fit(pieces: pd.DataFrame, capacity: int) -> np.ndarray:
    """Bin of each piece, the longest first."""
    room: list[int] = []
    out = np.zeros(len(pieces), np.int64)
    lengths = pieces["length"].to_numpy()
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= lengths[i]
        out[i] = k
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity`` ids."""
    cols = pieces.columns
    df = pieces.withColumn("k", F.expr(f"{capacity} div length")).withColumn("h", F.xxhash64("doc_id", "start", "ids_crc32"))
    df = df.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("nth", F.lit(None).cast("long"))
    order = ["doc_id", "start", "ids_crc32"]
    for level, buckets in enumerate(levels):
        # Pieces that have a sequence stay in groups of one sequence each, so they make no large group.
        df = df.withColumn("cell", F.when(F.col("sequence_id").isNull(), F.pmod("h", F.lit(buckets))).otherwise(-1 - F.col("sequence_id")))
        group = Window.partitionBy("k", "cell")
        df = df.withColumn("n", F.count("*").over(group)).withColumn("i", F.row_number().over(group.orderBy(*order)) - 1)
        whole = F.col("sequence_id").isNull() & (F.expr("i div k") < F.expr("n div k"))
        number = F.expr(f"shiftleft({level}L, 60) + shiftleft(cast(k - 1 AS long), 49) + shiftleft(cell, 39) + i div k")
        df = df.withColumn("nth", F.when(whole, F.col("i")).otherwise(F.col("nth"))).withColumn(
            "sequence_id", F.when(whole, number).otherwise(F.col("sequence_id")))
    df = materialize(df.drop("cell", "n", "i", "k", "h"))
    keep = [*cols, "sequence_id", "nth"]
    base = len(levels) << 60

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        return pdf.assign(sequence_id=base + first_fit(pdf, capacity), nth=np.arange(len(pdf), dtype=np.int64))[keep]

    left = df.where("sequence_id IS NULL").select(*keep).groupBy(F.col("sequence_id").isNull()).applyInPandas(rest, df.select(*keep).schema)
    before = Window.partitionBy("sequence_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return df.where("sequence_id IS NOT NULL").select(*keep).unionByName(left).select(
        *cols, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    return pack(cut_documents(docs, path))


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path(MODEL)))
