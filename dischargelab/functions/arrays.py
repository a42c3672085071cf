"""Array expressions over fixed-length waveforms; everything here stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A computed column named inside a lambda is otherwise inlined into it by projection collapsing
    and evaluated again for every array element.
    """
    return F.transform(F.array(value), body)[0]


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda p, q: p * q))


def sum_sq(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v * v)


def l2(a, b) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda p, q: (p - q) * (p - q))))


def l1(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + F.abs(v))


def mean(a) -> Column:
    return total(a) / F.size(_c(a))


def argmax_first(a) -> Column:
    """0-based index of the first maximum."""
    return let(_c(a), lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def scale(a, k: Column) -> Column:
    return let(k, lambda s: F.transform(_c(a), lambda v: v * s))


def minus(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p - q)


def shift(a, s: Column) -> Column:
    """Move right by ``s`` samples (left when negative); exposed samples are zero."""
    a, n = _c(a), F.size(_c(a))
    right, left = F.least(F.greatest(s, F.lit(0)), n), F.least(F.greatest(-s, F.lit(0)), n)
    pad = F.lit(0.0)
    return F.concat(F.array_repeat(pad, right), F.slice(a, left + 1, n - left - right), F.array_repeat(pad, left))


def normalize_area(a) -> Column:
    return let(l1(a), lambda s: F.when(s > 0, F.transform(_c(a), lambda v: v / s)).otherwise(_c(a)))


def normalize_peak(a) -> Column:
    peak = F.array_max(F.transform(_c(a), lambda v: F.abs(v)))
    return let(peak, lambda s: F.when(s > 0, F.transform(_c(a), lambda v: v / s)).otherwise(_c(a)))


def crop_center(a, half: int) -> Column:
    """The central ``2*half`` samples (fewer when the waveform is shorter)."""
    full = F.floor(F.size(_c(a)) / 2).cast("int")
    h = F.least(F.lit(int(half)), full)
    return F.slice(_c(a), full - h + 1, h * 2)


def time_axis_ms(n: Column, fs: float, centered: bool = True) -> Column:
    """Sample times in ms: from ``-n//2`` on (an even window), or ``(k - n/2)/fs``."""
    origin = F.floor(n / 2) if centered else n / 2
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: (k - origin) / fs * 1000.0)


def window_by_time(a, t_ms, lo: float, hi: float) -> Column:
    """Samples whose time lies in [lo, hi]."""
    pair = F.zip_with(_c(a), _c(t_ms), lambda v, t: F.struct(v.alias("v"), t.alias("t")))
    return F.transform(F.filter(pair, lambda z: z["t"].between(lo, hi)), lambda z: z["v"])


# --- orthonormal DCT-II, low terms only ---------------------------------------------------------

def dct_term(a, k: int) -> Column:
    """Coefficient ``k`` of the orthonormal DCT-II."""
    a = _c(a)
    n = F.size(a)
    raw = total(F.transform(a, lambda v, i: v * F.cos((i * 2 + 1) * (k * math.pi) / (n * 2))))
    return raw * F.sqrt((1.0 if k == 0 else 2.0) / n)


def dct_low(a, n_terms: int) -> Column:
    return F.array(*[dct_term(a, k) for k in range(n_terms)])


def dct_rebuild(terms, n: Column) -> Column:
    """Waveform of length ``n`` from its lowest coefficients."""
    return _add_cosines(F.array_repeat(F.lit(0.0), n), terms, n, 1.0)


def dct_remove(a, terms) -> Column:
    """The waveform without the given lowest coefficients."""
    return _add_cosines(_c(a), terms, F.size(_c(a)), -1.0)


def _add_cosines(start: Column, terms, n: Column, sign: float) -> Column:
    # The fold evaluates the coefficient array once, not once per sample.
    step = F.transform(_c(terms), lambda c, k: F.struct(
        (c * F.sqrt(F.when(k == 0, 1.0).otherwise(2.0) / n) * sign).alias("c"),
        (k * math.pi / (n * 2)).alias("w")))
    return F.aggregate(step, start, lambda acc, e: F.transform(
        acc, lambda v, i: v + e["c"] * F.cos((i * 2 + 1) * e["w"])))
