"""Numpy kernels against their definitions."""

import math

import numpy as np
import pytest

from evoka.functions import kernels

RATE = 256.0


def test_bandpass_gains():
    s = kernels.butterworth_bandpass(4, 0.5, 30, RATE)
    gain = np.abs(kernels.response(s, np.exp(2j * np.pi * np.array([0, 0.5, 4, 30, 60, 128]) / RATE)))
    assert gain == pytest.approx([0, 2**-0.5, 1, 2**-0.5, 0.031114, 0], abs=1e-5)


def test_zero_phase_keeps_the_band_and_drops_the_rest():
    s, t = kernels.butterworth_bandpass(4, 0.5, 30, RATE), np.arange(30 * 256) / RATE
    middle = slice(10 * 256, 20 * 256)
    kept = np.sin(2 * np.pi * 8 * t)
    assert np.abs(kernels.zero_phase(kept + 3, s) - kept)[middle].max() < 1e-2
    assert np.abs(kernels.zero_phase(np.sin(2 * np.pi * 60 * t), s))[middle].max() < 2e-3


def test_welch_of_a_sine_and_parseval():
    t = np.arange(4096) / RATE
    f, p = kernels.welch(np.sin(2 * np.pi * 16 * t), RATE, 1024, 512)
    assert f[np.argmax(p)] == 16
    assert np.trapezoid(p, f) == pytest.approx(0.5, rel=1e-2)
    assert kernels.welch(2 * t + 1, RATE, 512, 256, detrend="linear")[1].max() < 1e-20


def test_savgol_repeats_cubics_also_at_the_edges():
    t = np.linspace(-1, 1, 384)
    m = kernels.savgol_matrix(384, kernels.smoothing_length(0.12, RATE, 384, 3), 3)
    assert np.abs(m @ (t**3 - t) - (t**3 - t)).max() < 1e-12
    assert kernels.smoothing_length(0.12, RATE, 384, 3) == 31


def test_huber_resists_outliers_and_is_the_mean_of_clean_rows():
    rng = np.random.default_rng(1)
    clean = rng.uniform(-1, 1, (40, 3, 5))
    fit = lambda x: kernels.huber_location(x, 1.345, 30, 1e-7, 1.4826)
    assert np.abs(fit(clean) - clean.mean(axis=0)).max() < 0.2
    dirty = clean.copy()
    dirty[0] = 1e6
    assert np.abs(fit(dirty)).max() < 1
    with pytest.raises(ValueError):
        fit(clean[:1])


@pytest.mark.parametrize("n", [2, 5, 67, 128, 300, 2000])
def test_zero_phase_is_the_plain_recursion(n):
    sections, x = kernels.butterworth_bandpass(4, 0.5, 30, RATE), np.random.default_rng(n).normal(3, 2, n)
    pad = min(3 * (2 * len(sections) + 1), n - 1)
    y = [*(2 * x[0] - x[pad:0:-1]), *x, *(2 * x[-1] - x[-2 : -pad - 2 : -1])]
    for _ in range(2):
        level, scale = y[0], 1.0
        for b0, b1, b2, _, a1, a2 in sections:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            z1, z2, out = (gain - b0) * level * scale, (b2 - a2 * gain) * level * scale, []
            for v in y:
                w = b0 * v + z1
                z1, z2 = b1 * v - a1 * w + z2, b2 * v - a2 * w
                out.append(w)
            y, scale = out, scale * gain
        y = y[::-1]
    assert kernels.zero_phase(x, sections) == pytest.approx(np.array(y[pad : len(y) - pad]), abs=1e-9)


def test_logistic_gradient_is_zero_and_folds_are_even():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + rng.normal(size=80) > 0.5).astype(int)
    w = kernels.fit_logistic(x, y, 0.7)
    s, z = 2 * y - 1, np.column_stack([x, np.ones(80)])
    weight = np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (80 - y.sum())))
    gradient = w - 0.7 * z.T @ (weight * s / (1 + np.exp(s * (z @ w))))
    assert np.abs(gradient).max() < 1e-8
    fold = kernels.stratified_folds(y, 5, rng)
    assert all(np.ptp(np.bincount(fold[y == v], minlength=5)) <= 1 for v in (0, 1))


def test_hypergeometric_beyond_numpy(monkeypatch):
    """The accepted draws have numpy's distribution, and the moments of large ones."""
    rng = np.random.default_rng(0)
    monkeypatch.setattr(kernels, "MOST_ROWS", 0)
    for good, bad, n in ((4000, 6000, 50), (4000, 6000, 9000), (300, 20_000, 5000), (50_000, 50_000, 40_000)):
        own, other = kernels.hypergeometric(good, bad, np.full(40_000, n), rng), rng.hypergeometric(good, bad, n, 40_000)
        assert own.min() >= max(0, n - bad) and own.max() <= min(good, n)
        assert own.mean() == pytest.approx(other.mean(), abs=5 * other.std() / 200) and own.std() == pytest.approx(other.std(), rel=0.03)
        assert np.quantile(own, [0.1, 0.5, 0.9]) == pytest.approx(np.quantile(other, [0.1, 0.5, 0.9]), abs=max(1, 0.08 * other.std()))
    assert kernels.hypergeometric(7, 0, np.array([3, 0]), rng).tolist() == [3, 0] and kernels.hypergeometric(0, 7, np.array([3, 7]), rng).tolist() == [0, 0]
    good, bad, n = 3 * 10**11, 7 * 10**11, 4 * 10**11
    x, total = kernels.hypergeometric(good, bad, np.full(20_000, n), rng), good + bad
    spread = math.sqrt(n * (good / total) * (bad / total) * (total - n) / (total - 1))
    assert x.mean() - n * good / total == pytest.approx(0, abs=5 * spread / 141) and x.std() == pytest.approx(spread, rel=0.03)


@pytest.mark.parametrize("cuts", [[300], [1] * 40 + [260], [27, 28, 1, 100, 144], [150, 150], [3, 2], [1, 1], [5]])
def test_zero_phase_of_blocks_is_that_of_the_whole(cuts):
    sections, x = kernels.butterworth_bandpass(4, 0.5, 30, RATE), np.random.default_rng(len(cuts)).normal(3, 2, sum(cuts))
    blocks = np.split(x, np.cumsum(cuts)[:-1])
    made = [kernels.zero_phase_summary(b, sections) for b in blocks]
    most = kernels.zero_phase_pad(sections, 10**9) + 1
    states = kernels.zero_phase_states(cuts, [b[:most] for b in blocks], [b[-most:] for b in blocks], [m[0] for m in made], [m[1] for m in made], sections)
    found = np.concatenate([kernels.zero_phase_block(b, sections, f, s) for b, f, s in zip(blocks, *states, strict=True)])
    assert found == pytest.approx(kernels.zero_phase(x, sections), abs=1e-9)
