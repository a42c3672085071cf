"""Traces as one row per (run, block): samples cross the network once, later stages move blocks and edges.

``pack`` gathers samples (keys, i, v) into blocks of ``size`` to ``2 * size - 1`` samples (the last block of a run takes
the remainder), whatever the run's length. Everything behind it works on block rows (keys, blk, nb, i0, v array):

* Zero-phase filters are an associative scan. A filter is a sum of one-pole modes, so a block acts on the modes' states
  as an affine map: it decays them and adds its own. One pass reduces blocks to such maps, a prefix product over blocks
  gives the exact state before each, and a second pass filters from there; then the same from the other end. No halo is
  needed, however low the cut-off is.
* Moving windows take the edges of the two neighbour blocks by a join on block rows.
* Order statistics descend the bits of the doubles with one histogram per run and pass; no sample is sorted or sent.
* Peaks are sparse rows; they meet their blocks as one list per block, so a block's samples are never copied per peak.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dischargelab.functions.filters import design
from dischargelab.session import attach, materialize

SIZE = 1 << 13
SPAN = 1024  # blocks whose state maps are multiplied in one group


def block_of(nb: str = "nb", i: str = "i", size: int = SIZE):
    return F.least(F.expr(f"{i} div {size}"), F.col(nb) - 1)


def runs_of(trace: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, n, nb): samples and blocks of every run."""
    return trace.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("nb", F.expr(f"greatest(n div {size}, 1L)"))


def pack(trace: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, blk, nb, i0, v): samples i0, i0 + 1, ... of a block as one array; ``i`` is dense from 0 in every run."""
    rows = attach(trace.select(*keys, "i", F.col("v").cast("double").alias("v")), runs_of(trace, keys, size).drop("n"), keys)
    packed = rows.groupBy(*keys, "nb", block_of(size=size).alias("blk")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    return packed.select(*keys, "blk", "nb", F.col("s")[0]["i"].alias("i0"), F.transform("s", lambda s: s["v"]).alias("v"))


def unpack(packed: DataFrame, keys: list[str]) -> DataFrame:
    return packed.select(*keys, "i0", F.posexplode("v").alias("p", "v")).select(*keys, (F.col("i0") + F.col("p")).alias("i"), "v")


def _block_schema(packed: DataFrame, keys: list[str], extra: list[T.StructField]) -> T.StructType:
    return T.StructType([packed.schema[k] for k in (*keys, "blk", "nb", "i0")] + extra)


ARRAY = T.ArrayType(T.DoubleType())


def map_blocks(packed: DataFrame, keys: list[str], fn: Callable, out: str = "v") -> DataFrame:
    """``fn(row)`` gives one array per block, which replaces ``v``."""
    cols = [*keys, "blk", "nb", "i0"]

    def run(batches):
        for pdf in batches:
            res = pdf[cols].copy()
            res[out] = pd.Series([fn(r) for r in pdf.itertuples(index=False)], index=pdf.index, dtype=object)
            yield res

    return packed.mapInPandas(run, _block_schema(packed, keys, [T.StructField(out, ARRAY)]))


# --- zero-phase filters -------------------------------------------------------------------------

@lru_cache(maxsize=32)
def modes(spec: tuple) -> tuple[np.ndarray, np.ndarray, float, int]:
    """A filter as d + sum r / (1 - p z^-1): (poles, residues, d, edge padding)."""
    z, p, gain, pad, _ = design(*spec)
    up = np.prod(1 - z[None, :] / p[:, None], axis=1)
    apart = 1 - p[None, :] / p[:, None]
    np.fill_diagonal(apart, 1)
    return p, gain * up / np.prod(apart, axis=1), float(np.real(gain * np.prod(z) / np.prod(p))), pad


@lru_cache(maxsize=64)
def _tables(spec: tuple, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Powers 0 .. n of the poles, and the transform of the first n samples of the impulse response."""
    p, r, d, _ = modes(spec)
    powers = np.exp(np.arange(n + 1) * np.log(p)[:, None])
    h = np.real(r @ powers[:, :n])
    h[0] += d
    n_fft = 1 << int(2 * n - 1).bit_length()
    return powers, np.fft.rfft(h, n_fft), n_fft


def end_state(x: np.ndarray, spec: tuple, start: np.ndarray) -> np.ndarray:
    """The modes' states behind x."""
    powers, _, _ = _tables(spec, len(x))
    return powers[:, -1] * start + powers[:, :-1][:, ::-1] @ x


def filtered_from(x: np.ndarray, spec: tuple, start: np.ndarray) -> np.ndarray:
    powers, h, n_fft = _tables(spec, len(x))
    y = np.fft.irfft(np.fft.rfft(x, n_fft) * h, n_fft)[: len(x)]
    return y + np.real((modes(spec)[1] * start) @ powers[:, 1:])


def resting(x0: float, spec: tuple) -> np.ndarray:
    """States after x0 has been held forever."""
    return x0 / (1 - modes(spec)[0])


def padded(v: np.ndarray, first: bool, last: bool, pad: int) -> np.ndarray:
    """A true end of the recording is extended by odd reflection."""
    if len(v) <= pad and (first or last):
        raise ValueError(f"a recording needs more than {pad} samples to be filtered")
    return np.concatenate([2 * v[0] - v[pad:0:-1] if first else v[:0], v, 2 * v[-1] - v[-2:-pad - 2:-1] if last else v[:0]])


def _flat(s: np.ndarray) -> np.ndarray:
    return np.concatenate([s.real, s.imag])


def _state(a) -> np.ndarray:
    a = np.asarray(a, dtype=float)
    return a[: len(a) // 2] + 1j * a[len(a) // 2:]


def states_before(maps: DataFrame, keys: list[str], spec: tuple, backward: bool) -> DataFrame:
    """(keys, blk, at): exact states before every block, from (keys, blk, n, s), where a block of n samples adds s to what
    is left of the states before it. Maps are multiplied inside spans of blocks, then over a run's spans."""
    poles = modes(spec)[0]

    def scan(pdf: pd.DataFrame, place: str) -> pd.DataFrame:
        """Samples since the group's start, and the states that they leave from zero ones."""
        pdf = pdf.sort_values(place, ascending=not backward, ignore_index=True)
        n, at, before, out = 0, np.zeros(len(poles), complex), [], []
        for size, s in zip(pdf["n"], pdf["s"], strict=True):
            before.append(n)
            out.append(_flat(at))
            n, at = n + size, poles**size * at + _state(s)
        whole = pd.DataFrame({"before": before, "at": pd.Series(out, dtype=object)})
        whole["n"], whole["s"] = n, pd.Series([_flat(at)] * len(pdf), dtype=object)
        return pd.concat([pdf.drop(columns=["n", "s"]), whole], axis=1)

    kept = [maps.schema[k] for k in keys]
    own = T.StructType([*kept, maps.schema["blk"], T.StructField("span", T.LongType()), T.StructField("before", T.LongType()),
                        T.StructField("at", ARRAY), T.StructField("n", T.LongType()), T.StructField("s", ARRAY)])
    spans = maps.select(*keys, "blk", F.expr(f"blk div {SPAN}").alias("span"), "n", "s").groupBy(*keys, "span").applyInPandas(
        lambda pdf: scan(pdf, "blk")[[f.name for f in own]], own)
    spans = materialize(spans)
    wide = T.StructType([*kept, T.StructField("span", T.LongType()), T.StructField("lead", ARRAY)])
    lead = spans.select(*keys, "span", "n", "s").dropDuplicates([*keys, "span"]).groupBy(*keys).applyInPandas(
        lambda pdf: scan(pdf, "span").rename(columns={"at": "lead"})[[f.name for f in wide]], wide)
    rows = spans.select(*keys, "blk", "span", "before", "at").join(lead, [*keys, "span"])

    @F.pandas_udf(ARRAY)
    def joined(before: pd.Series, at: pd.Series, lead: pd.Series) -> pd.Series:
        return pd.Series([_flat(poles**n * _state(s) + _state(a)) for n, a, s in zip(before, at, lead, strict=True)], dtype=object)

    return rows.select(*keys, "blk", joined("before", "at", "lead").alias("at"))


def zero_phase_blocks(packed: DataFrame, keys: list[str], kind: str, low: float, high: float | None, fs: float) -> DataFrame:
    """Forward-backward filter of every run; equals the filter of the whole run, whatever the blocks."""
    spec = (kind, float(low), None if high is None else float(high), float(fs))
    pad = modes(spec)[3]
    none = np.zeros(len(modes(spec)[0]), complex)

    def edges(r):
        return r.blk == 0, r.blk == r.nb - 1

    def forward_map(r):
        x = padded(np.asarray(r.v), *edges(r), pad)
        return np.r_[len(x), _flat(end_state(x, spec, resting(x[0], spec) if r.blk == 0 else none))]

    def forward(r):
        x = padded(np.asarray(r.v), *edges(r), pad)
        return filtered_from(x, spec, resting(x[0], spec) if r.blk == 0 else _state(r.at))

    def backward_map(r):
        y = forward(r)[::-1]
        return np.r_[len(y), _flat(end_state(y, spec, resting(y[0], spec) if r.blk == r.nb - 1 else none))]

    def backward(r):
        y = forward(r)[::-1]
        y = filtered_from(y, spec, resting(y[0], spec) if r.blk == r.nb - 1 else _state(r.back))[::-1]
        return y[pad if r.blk == 0 else 0:][: len(r.v)]

    def scanned(maps: DataFrame, backward: bool) -> DataFrame:
        m = maps.select(*keys, "blk", F.col("m")[0].cast("long").alias("n"), F.slice("m", 2, 2 * len(none)).alias("s"))
        return states_before(m, keys, spec, backward)

    on = [*keys, "blk"]
    ahead = packed.join(scanned(map_blocks(packed, keys, forward_map, "m"), False), on)
    back = scanned(map_blocks(ahead, keys, backward_map, "m"), True).withColumnRenamed("at", "back")
    return map_blocks(ahead.join(back, on), keys, backward)


# --- windows, order statistics and peaks --------------------------------------------------------

def with_edges(packed: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """Adds ``head`` and ``tail``: the samples next to a block, up to ``before`` of the block to its left and ``after`` to its right."""
    ends = []
    if before:
        ends.append(packed.select(*keys, (F.col("blk") + 1).alias("blk"), F.lit(0).alias("side"), F.expr(f"slice(v, -least({before}, size(v)), {before})").alias("e")))
    if after:
        ends.append(packed.select(*keys, (F.col("blk") - 1).alias("blk"), F.lit(1).alias("side"), F.slice("v", 1, after).alias("e")))
    if not ends:
        return packed.withColumn("head", F.array().cast("array<double>")).withColumn("tail", F.array().cast("array<double>"))
    met = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
    sides = met.groupBy(*keys, "blk").agg(*[F.max(F.when(F.col("side") == s, F.col("e"))).alias(n) for s, n in ((0, "head"), (1, "tail"))])
    joined = packed.join(sides, [*keys, "blk"], "left")
    return joined.select(*packed.columns, *[F.coalesce(c, F.array().cast("array<double>")).alias(c) for c in ("head", "tail")])


def envelope_blocks(packed: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Moving average of absolute values that treats samples outside the run as zero; an even window leans back."""
    back, ahead = width // 2, width - 1 - width // 2

    def average(r):
        x = np.abs(np.concatenate([r.head, r.v, r.tail]))
        x = np.concatenate([np.zeros(back - len(r.head)), x, np.zeros(ahead - len(r.tail))])
        return np.lib.stride_tricks.sliding_window_view(x, width).sum(axis=1) / width

    return map_blocks(with_edges(packed, keys, back, ahead), keys, average)


DIGIT = 16  # bits of a double that one pass decides


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    b = (np.asarray(x, dtype=float) + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63))


def double_of(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(float)[0])


def block_quantiles(packed: DataFrame, keys: list[str], qs: dict[str, float], first: int | None = None) -> DataFrame:
    """(keys, one column per quantile): exact, interpolated between the two nearest values; ``first`` limits it to the first
    samples of a run.

    Four passes over the blocks decide 16 bits each. A pass sends, per run and task, one histogram of the values that agree
    with the bits so far; ranks of all quantiles descend together.
    """
    schema = T.StructType([packed.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in ("prefix", "digit", "n")])

    def values(r):
        return np.asarray(r.v)[: max(0, first - r.i0)] if first is not None else np.asarray(r.v)

    live = packed if first is None else packed.where(F.col("i0") < first)
    count = F.sum(F.size("v")) if first is None else F.sum(F.least(F.size("v"), F.lit(first) - F.col("i0")))
    n = live.groupBy(*keys).agg(count.cast("long").alias("n"))
    place = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(k).alias("side"), (getattr(F, f)((F.col("n") - 1) * F.lit(float(q)))).cast("long").alias("rank"))
                      for name, q in qs.items() for k, f in ((0, "floor"), (1, "ceil"))])
    ranks = materialize(n.select(*keys, "n", F.explode(place).alias("w")).select(*keys, "n", "w.*", F.lit(0).cast("long").alias("prefix")))
    for level in range(64 // DIGIT):
        shift = 64 - DIGIT * (level + 1)
        wanted = ranks.groupBy(*keys).agg(F.collect_set("prefix").alias("prefixes"))  # two for each quantile

        def histogram(batches, shift=shift):
            acc: dict = {}
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    bits = ordered_bits(values(r))
                    above, low = bits >> np.uint64(shift), np.uint64((1 << DIGIT) - 1)
                    for p in r.prefixes:
                        digit, c = np.unique((above[above >> np.uint64(DIGIT) == np.uint64(p)] & low).astype(np.int64), return_counts=True)
                        own = acc.setdefault((*(getattr(r, k) for k in keys), p), np.zeros(1 << DIGIT, np.int64))
                        own[digit] += c
            for key, h in acc.items():
                at = np.flatnonzero(h)
                yield pd.DataFrame({**{k: v for k, v in zip((*keys, "prefix"), key)}, "digit": at, "n": h[at]})

        bins = attach(live, wanted, keys).mapInPandas(histogram, schema).groupBy(*keys, "prefix", "digit").agg(F.sum("n").alias("m"))
        upto = Window.partitionBy(*keys, "prefix").orderBy("digit")  # at most 2 ** DIGIT rows
        bins = bins.withColumn("upto", F.sum("m").over(upto)).withColumn("below", F.col("upto") - F.col("m"))
        hit = ranks.join(bins, [*keys, "prefix"]).where("rank >= below AND rank < upto")
        ranks = materialize(hit.select(*keys, "n", "name", "side", (F.col("rank") - F.col("below")).alias("rank"),
                                       F.expr(f"shiftleft(prefix, {DIGIT}) | digit").alias("prefix")))

    @F.pandas_udf("double")
    def value(p: pd.Series) -> pd.Series:
        return p.map(lambda v: double_of(int(v) & ((1 << 64) - 1)))

    vals = ranks.withColumn("value", value("prefix")).groupBy(*keys, "n", "name").agg(
        F.max(F.when(F.col("side") == 0, F.col("value"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("high"))
    q = F.create_map(*[F.lit(v) for name, q in qs.items() for v in (name, float(q))])[F.col("name")]
    share = (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return vals.groupBy(*keys).pivot("name", list(qs)).agg(F.first(F.col("low") + (F.col("high") - F.col("low")) * share))


def marks_of(packed: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, v, kind, falls): rows of single maxima ("peak") and of both ends of flat stretches, from the threshold on."""
    schema = T.StructType([packed.schema[k] for k in keys] + [
        T.StructField("i", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("kind", T.StringType()), T.StructField("falls", T.BooleanType())])

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                v = np.asarray(r.v)
                left = np.r_[r.head[-1] if len(r.head) else np.nan, v[:-1]]
                right = np.r_[v[1:], r.tail[0] if len(r.tail) else np.nan]
                rises, falls, high = v > left, v > right, v >= r.threshold
                kind = np.select([rises & falls & high, rises & (v == right) & high, (v == left) & ~(v == right) & high], [1, 2, 3], 0)
                at = np.flatnonzero(kind)
                if len(at):
                    yield pd.DataFrame({**{k: getattr(r, k) for k in keys}, "i": r.i0 + at, "v": v[at],
                                        "kind": np.array(["", "peak", "start", "end"], object)[kind[at]], "falls": falls[at]})

    rows = attach(with_edges(packed, keys, 1, 1), thresholds.select(*keys, "threshold"), keys)
    return rows.mapInPandas(run, schema)


def at_peaks(packed: DataFrame, peaks: DataFrame, keys: list[str], before: int, after: int, fn: Callable, out: T.DataType, size: int = SIZE) -> DataFrame:
    """``peaks`` (keys, i) with ``got``: ``fn(window, lo, i)`` of the samples [i - before, i + after) that the run has,
    ``lo`` being the index of the first; peaks for which it is None are left out."""
    runs = packed.select(*keys, "nb").distinct()
    lists = attach(peaks.select(*keys, "i"), runs, keys).groupBy(*keys, block_of(size=size).alias("blk")).agg(F.collect_list("i").alias("at"))
    schema = T.StructType([packed.schema[k] for k in keys] + [T.StructField("i", T.LongType()), T.StructField("got", out)])

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, start = np.concatenate([r.head, r.v, r.tail]), r.i0 - len(r.head)
                i = np.sort(np.asarray(r.at))
                lo, hi = np.maximum(i - before - start, 0), np.minimum(i + after - start, len(x))
                got = [(int(p), g) for p, s, e in zip(i, lo, hi, strict=True) if (g := fn(x[s:e], int(start + s), int(p))) is not None]
                if got:
                    yield pd.DataFrame({**{k: getattr(r, k) for k in keys}, "i": [p for p, _ in got], "got": pd.Series([g for _, g in got], dtype=object if isinstance(out, T.ArrayType) else None)})

    return with_edges(packed, keys, before, after).join(lists, [*keys, "blk"]).mapInPandas(run, schema)
