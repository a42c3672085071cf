"""Words of Arrow text columns as byte ranges, for kernels that work on whole batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Words:
    data: np.ndarray  # bytes of the column, A-Z lower-cased
    bounds: np.ndarray  # text i is data[bounds[i]:bounds[i + 1]]
    start: np.ndarray  # word j is data[start[j]:end[j]]
    end: np.ndarray
    first: np.ndarray  # text i has the words first[i] to first[i + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where they begin; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]: bounds[-1]], bounds - bounds[0]


def split_words(column: pa.Array, is_space: np.ndarray = IS_SPACE, fold: np.ndarray = ASCII_LOWER) -> Words:
    raw, bounds = text_bytes(column)
    data = fold[raw]
    solid = ~is_space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True  # no word goes on into the next text
    before = np.r_[False, solid[:-1]] if len(data) else solid
    after = np.r_[solid[1:], False] if len(data) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of given starts and sizes, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def byte_slices(batch: pa.RecordBatch, column: int | str, limit: int = 4 << 20):
    """Slices of a batch of at most ``limit`` bytes of text each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


FACTOR, CHUNKS = np.uint64(0x9E3779B97F4A7C15), 8
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, taken eight at a time; words beyond CHUNKS times eight add a sum over all their bytes."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    sizes = w.end - w.start
    eights = np.ndarray(len(w.data) + 1, "<u8", np.r_[w.data, np.zeros(8, np.uint8)], strides=(1,))
    h = mixed(eights[w.start] & LOW_BYTES[np.minimum(sizes, 8)] ^ sizes.astype(np.uint64) * FACTOR)
    more = np.arange(len(sizes))
    for at in range(8, 8 * CHUNKS, 8):
        more = more[sizes[more] > at]
        h[more] = mixed(h[more] * FACTOR + (eights[w.start[more] + at] & LOW_BYTES[np.minimum(sizes[more] - at, 8)]))
    more = more[sizes[more] > 8 * CHUNKS]
    if len(more):
        own = sizes[more]
        power = np.cumprod(np.full(int(own.max()), FACTOR, np.uint64))
        weighed = (w.data[runs(w.start[more], own)].astype(np.uint64) + np.uint64(1)) * power[runs(np.zeros(len(own), np.int64), own)]
        h[more] = mixed(h[more] + np.add.reduceat(weighed, np.cumsum(own) - own))
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ (h >> np.uint64(32))
