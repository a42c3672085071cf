"""Butterworth design and zero-phase filtering of one bounded block of samples."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ORDER = 4
TAIL = 1e-17  # an impulse response is cut where its envelope falls below this


@lru_cache(maxsize=64)
def design(kind: str, low: float, high: float | None, fs: float) -> tuple[np.ndarray, np.ndarray, float, int, int]:
    """Digital order-4 Butterworth as (zeros, poles, gain, edge padding, settling samples).

    Zeros and poles are used as they are: the polynomial form of the 20 Hz band edge at 24 kHz is
    ill-conditioned. The upper edge of a band is held below the Nyquist frequency.
    """
    nyq = fs / 2
    k = np.arange(1, ORDER + 1)
    proto = np.exp(1j * np.pi * (2 * k + ORDER - 1) / (2 * ORDER))

    def warp(hz):
        return 4.0 * np.tan(np.pi * (hz / nyq) / 2)

    if kind == "highpass":
        poles = warp(min(low, nyq * 0.99)) / proto
        zeros = np.zeros(ORDER)
        gain = 1.0 / np.real(np.prod(-proto))
        pad = 3 * (ORDER + 1)
    else:
        w1, w2 = warp(low), warp(min(high, nyq * 0.99))
        half = proto * (w2 - w1) / 2
        root = np.sqrt(half ** 2 - w1 * w2)
        poles = np.concatenate([half + root, half - root])
        zeros = np.zeros(ORDER)
        gain = (w2 - w1) ** ORDER
        pad = 3 * (2 * ORDER + 1)
    gain = gain * np.real(np.prod(4.0 - zeros) / np.prod(4.0 - poles))
    z = np.concatenate([(4.0 + zeros) / (4.0 - zeros), -np.ones(len(poles) - len(zeros))])
    p = (4.0 + poles) / (4.0 - poles)
    settle = int(np.ceil(np.log(TAIL) / np.log(np.abs(p).max()))) + 16
    return z, p, float(gain), pad, settle


@lru_cache(maxsize=16)
def _response(kind, low, high, fs, n_fft) -> np.ndarray:
    z, p, gain, _, _ = design(kind, low, high, fs)
    w = np.exp(2j * np.pi * np.arange(n_fft // 2 + 1) / n_fft)
    h = np.full(len(w), gain, dtype=complex)
    for a in z:
        h *= w - a
    for b in p:
        h /= w - b
    return h


def _one_way(x: np.ndarray, spec, settle: int) -> np.ndarray:
    """Causal filter whose past is the first sample held forever (its steady state)."""
    padded = np.concatenate([np.full(settle, x[0]), x])
    n_fft = 1 << int(len(padded) - 1).bit_length()
    y = np.fft.irfft(np.fft.rfft(padded, n_fft) * _response(*spec, n_fft), n_fft)
    return y[settle:settle + len(x)]


def zero_phase(x: np.ndarray, kind: str, low: float, high: float | None, fs: float,
               at_start: bool = True, at_end: bool = True) -> np.ndarray:
    """Forward-backward filter; a true end of the recording is extended by odd reflection."""
    spec = (kind, float(low), None if high is None else float(high), float(fs))
    _, _, _, pad, settle = design(*spec)
    x = np.asarray(x, dtype=float)
    if len(x) <= pad and (at_start or at_end):
        raise ValueError(f"a recording needs more than {pad} samples to be filtered")
    left = 2 * x[0] - x[pad:0:-1] if at_start else x[:0]
    right = 2 * x[-1] - x[-2:-pad - 2:-1] if at_end else x[:0]
    y = _one_way(np.concatenate([left, x, right]), spec, settle)
    y = _one_way(y[::-1], spec, settle)[::-1]
    return y[len(left):len(left) + len(x)]


def morlet_power(x: np.ndarray, fs: float, fmin: float, fmax: float, n_freqs: int,
                 bandwidth: float = 1.5, center: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Power of a complex Morlet transform at log-spaced frequencies: (freqs, power)."""
    freqs = np.geomspace(fmin, min(fmax, fs / 2), n_freqs)
    grid = np.linspace(-8.0, 8.0, 1024)
    psi = np.exp(2j * np.pi * center * grid - grid ** 2 / bandwidth) / np.sqrt(np.pi * bandwidth)
    step = grid[1] - grid[0]
    integral = np.conj(np.cumsum(psi) * step)
    power = np.empty((n_freqs, len(x)))
    for r, scale in enumerate(center * fs / freqs):
        j = np.floor(np.arange(scale * (grid[-1] - grid[0]) + 1) / (scale * step)).astype(int)
        kernel = integral[j[j < len(integral)]][::-1]
        coef = -np.sqrt(scale) * np.diff(np.convolve(x, kernel))
        cut = (len(coef) - len(x)) / 2
        coef = coef[int(np.floor(cut)):len(coef) - int(np.ceil(cut))]
        power[r] = np.abs(coef) ** 2
    return freqs, power
