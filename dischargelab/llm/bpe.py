"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved down to leaves, leaves are encoded, and neighbours are joined: a window of text around
the cut is encoded again, and grows until the tokens outside it provably stay.

* Between matches of the pattern: a change of character class after a non-space ends every match that
  could reach it, whatever lies on either side (the one exception, an apostrophe before a letter, is left
  out). If the window ends at such places on both sides, nothing outside can change.
* Inside one match (a run of one class longer than the window): a token sequence is the encoding of
  its bytes if every two neighbours are the encoding of theirs. So tokens around the cut are encoded
  again, one, two, four, ... of them, until both seams of the new part are such pairs.

Decoding concatenates the tokens' bytes up a tree as well.

Ids are packed little-endian unsigned 32-bit integers, so that a row stays one binary value.
Defined cases: a null or empty text has no ids and decodes to no bytes; rows are independent, so
repeated ids and null doc_ids pass through; an empty table gives no rows. A text is encoded in the
task that holds its row; memory there is a few times the text.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dischargelab.llm.common import map_batches, slim, table

LEAF_CHARS, LEAF_TOKENS, WINDOW = 4096, 2048, 32
RANKS = "byte_bpe_50k.tiktoken"
# Unicode's White_Space characters.
WHITE = frozenset(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


@functools.lru_cache(maxsize=4096)
def kind(ch: str) -> str:
    """Class of a character in the pattern: S, L, N, O; or ? where Unicode versions may differ."""
    if ch in WHITE:
        return "S"
    cat = unicodedata.category(ch)
    return "?" if cat == "Cn" else cat[0] if cat[0] in "LN" else "O"


def forced(x: str, y: str) -> bool:
    """No match reaches across x|y, and no match to the left of it depends on what follows."""
    a, b = kind(x), kind(y)
    return a not in (b, "S", "?") and b != "?" and not (x == "'" and b == "L")


def last_cut(text: str, window: int) -> int | None:
    for i in range(len(text) - 1, max(0, len(text) - window), -1):
        if forced(text[i - 1], text[i]):
            return i
    return 0 if window >= len(text) else None


def first_cut(text: str, window: int) -> int | None:
    for i in range(1, min(window, len(text))):
        if forced(text[i - 1], text[i]):
            return i
    return len(text) if window >= len(text) else None


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS):
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.leaf = leaf

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return np.array(self.enc.encode_ordinary(text), dtype="<u4")
        a, b = text[: len(text) // 2], text[len(text) // 2:]
        return self.join(a, self.encode(a), b, self.encode(b))

    def join(self, a: str, left: np.ndarray, b: str, right: np.ndarray) -> np.ndarray:
        """encode(a + b) from encode(a) and encode(b)."""
        window = WINDOW
        while (p := last_cut(a, window)) is None or (q := first_cut(b, window)) is None:
            inside = self.join_inside(a[-window:], left, b[:window], right)
            if inside is not None:
                return inside
            window *= 2
        middle = np.array(self.enc.encode_ordinary(a[p:] + b[:q]), dtype="<u4")
        keep = len(left) - self.covering(left[::-1], len(a[p:].encode()))
        return np.concatenate([left[:keep], middle, right[self.covering(right, len(b[:q].encode())):]])

    def covering(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many tokens from the start hold exactly ``n_bytes``."""
        k = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[k]])
            k += 1
        return k

    def join_inside(self, a: str, left: np.ndarray, b: str, right: np.ndarray) -> np.ndarray | None:
        """The same within one match; None if a and b aren't a run of one class or don't suffice."""
        kinds = {kind(c) for c in a} | {kind(c) for c in b}
        if len(kinds) > 1 or kinds & {"S", "?"} or "'" in a or "'" in b:
            return None
        room = len(a[4:].encode()), len(b.encode())  # a contraction may end within the first characters
        k = 1
        while k < min(len(left), len(right)):
            tail, head = left[len(left) - k:], right[:k]
            x, y = (b"".join(self.bytes_of[i] for i in ids) for ids in (tail, head))
            outer = int(left[len(left) - k - 1]), int(right[k])
            if len(x) + len(self.bytes_of[outer[0]]) > room[0] or len(y) + len(self.bytes_of[outer[1]]) > room[1]:
                return None
            middle = self.piece(x + y)
            if self.stable(outer[0], middle[0]) and self.stable(middle[-1], outer[1]):
                return np.concatenate([left[: len(left) - k], np.array(middle, dtype="<u4"), right[k:]])
            k *= 2
        return None

    def piece(self, data: bytes) -> list[int]:
        return self.enc._core_bpe.encode_single_piece(data)

    def stable(self, x: int, y: int) -> bool:
        return self.piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary) of every row; ``path`` names the ranks on every executor."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        ids = [c.encode(t).tobytes() if t else b"" for t in batch.column("text").to_pylist()]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())})

    return map_batches(slim(docs, id_col, text_col), kernel, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) to (doc_id, ids)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        out = [c.decode(np.frombuffer(b or b"", dtype="<u4")) for b in batch.column("ids").to_pylist()]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "decoded": pa.array(out, pa.binary())})

    return map_batches(encoded.select("doc_id", "ids"), kernel, "doc_id long, ids binary, decoded binary", "ids")


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = str(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN
    both = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
