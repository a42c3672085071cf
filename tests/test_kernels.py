import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dischargelab.functions.embed import conditional_p, tsne
from dischargelab.functions.filters import design, morlet_power, zero_phase
from dischargelab.functions.graphs import hdbscan, union_labels
from dischargelab.functions.kernels import greedy_spacing, window_bounds
from dischargelab.operators.features import SYMLETS, dwt, wavelet_level
from dischargelab.operators.gap import anchor_merge

FS = 24000.0


def brute_greedy(t, rank, radius):
    kept = []
    for i in np.argsort(rank):
        if all(abs(t[i] - t[j]) >= radius for j in kept):
            kept.append(i)
    return np.isin(np.arange(len(t)), kept)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 5)), min_size=1, max_size=40), st.integers(1, 9))
def test_greedy_matches_definition(rows, radius):
    rows = sorted(rows)
    t = np.array([r[0] for r in rows], dtype=float)
    rank = np.empty(len(t), dtype=int)
    rank[np.lexsort((np.arange(len(t)), t, -np.array([r[1] for r in rows])))] = np.arange(len(t))
    assert (greedy_spacing(t, rank, float(radius)) == 1).tolist() == brute_greedy(t, rank, radius).tolist()


def test_greedy_boundary_is_strict():
    t, rank = np.array([0.0, 0.01, 0.02]), np.array([1, 0, 2])
    assert (greedy_spacing(t, rank, 0.01) == 1).all()
    assert (greedy_spacing(t, rank, 0.0100001) == 1).tolist() == [False, True, False]


def test_window_bounds_stay_in_group():
    lo, hi = window_bounds(np.array([0.0, 1.0, 0.5, 0.6]), np.array([0, 0, 1, 1]), 5.0)
    assert lo.tolist() == [0, 0, 2, 2] and hi.tolist() == [2, 2, 4, 4]


def recursive_filter(x, kind, low, high):
    """Direct-form sections from the same zeros and poles, started in steady state."""
    z, p, k, pad, _ = design(kind, low, high, FS)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])

    def one_way(v):
        n = 200_000 if kind == "bandpass" else 20_000
        y = np.concatenate([np.full(n, v[0]), v]).astype(complex)
        for zz, pp in zip(z, p):
            out, xp, yp = np.empty_like(y), y[0], y[0] * (1 - zz) / (1 - pp)
            for i, u in enumerate(y):
                yp = u - zz * xp + pp * yp
                xp = u
                out[i] = yp
            y = out
        return (k * y[n:]).real

    y = one_way(one_way(ext)[::-1])[::-1]
    return y[pad:-pad]


def test_highpass_equals_recursion():
    x = np.random.default_rng(0).normal(size=400) + 5
    ref = recursive_filter(x, "highpass", 100.0, None)
    assert np.allclose(zero_phase(x, "highpass", 100.0, None, FS), ref, atol=1e-9 * np.abs(ref).max())


def test_filter_response():
    t = np.arange(48000) / FS
    mid = slice(12000, 36000)
    inband = np.sin(2 * np.pi * 1000 * t)
    assert np.abs(zero_phase(inband, "bandpass", 20, 10000, FS)[mid] - inband[mid]).max() < 1e-3
    assert np.abs(zero_phase(np.ones(48000), "bandpass", 20, 10000, FS)).max() < 1e-6
    edge = zero_phase(np.sin(2 * np.pi * 500 * t), "highpass", 500, None, FS)[mid]
    assert abs(edge.max() - 0.5) < 1e-3  # half amplitude at the cut-off after two passes


def test_upper_edge_is_clamped():
    assert np.isfinite(zero_phase(np.random.default_rng(1).normal(size=2000), "bandpass", 20, 1e6, 1000.0)).all()


@pytest.mark.parametrize("wavelet", sorted(SYMLETS))
def test_wavelet_is_orthonormal(wavelet):
    lo = np.array(SYMLETS[wavelet])
    assert abs((lo ** 2).sum() - 1) < 1e-8 and abs(lo.sum() - np.sqrt(2)) < 1e-8
    assert wavelet_level(240, "sym2", None) == 6 and wavelet_level(240, "sym4", None) == 5
    c = dwt(np.ones((1, 64)), wavelet, 2)
    assert np.allclose(c[0, -(64 + len(lo) - 1) // 2:], 0, atol=1e-8)  # a constant has no detail


def test_scalogram_peaks_at_tone():
    x = np.sin(2 * np.pi * 800 * np.arange(4800) / FS)
    f, p = morlet_power(x, FS, 50, 5000, 64)
    assert p.shape == (64, 4800) and abs(f[p[:, 2400].argmax()] - 800) < 60


def test_affinities_reach_perplexity():
    x = np.random.default_rng(0).normal(size=(80, 4))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    p = conditional_p(d, 12.0)
    ent = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
    assert np.allclose(np.exp(ent), 12.0, rtol=1e-3)


def test_tsne_keeps_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (60, 8)) for c in (-3, 0, 3)])
    y = tsne(x, n_iter=300)
    lab = np.repeat([0, 1, 2], 60)
    near = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(near, np.inf)
    assert (lab[near.argmin(1)] == lab).mean() > 0.98


def test_hdbscan_two_blobs_and_noise():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (50, 2)), rng.normal(5, 0.1, (50, 2)), [[2.5, 20.0]]])
    lab = hdbscan(x, 5)
    assert lab[100] == -1 and len(set(lab[:50])) == 1 and len(set(lab[50:100])) == 1 and lab[0] != lab[50]


def test_union_labels():
    assert union_labels(6, np.array([[0, 3], [3, 5], [1, 2]])).tolist() == [0, 1, 1, 0, 2, 0]


def test_anchor_merge_rules():
    same = {(a, b): False for a in range(4) for b in range(a + 1, 4)}
    same[0, 2] = same[0, 3] = same[1, 2] = same[2, 3] = True
    ids, log = anchor_merge(4, same)
    # 0 takes 2 and stops; 2 is gone for 1 and as an anchor; 3 stays alone.
    assert ids == [0, 1, 0, 2] and [(a, b) for a, b, _ in log] == [(0, 1), (0, 2), (1, 3)]
