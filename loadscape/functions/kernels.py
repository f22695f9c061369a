"""Numerical kernels on numpy arrays, used inside Arrow functions; each works on one series."""

from __future__ import annotations

import numpy as np


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation (Fritsch and Butland) of the points (x, y)."""
    x, y, at = (np.asarray(a, float) for a in (x, y, at))
    if len(x) == 1:
        return np.full(len(at), y[0])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return y[0] + d[0] * (at - x[0])
    slope = np.zeros(len(x))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = d[:-1] * d[1:] > 0
    slope[1:-1][same] = ((w1 + w2)[same]) / (w1[same] / d[:-1][same] + w2[same] / d[1:][same])
    for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(s) != np.sign(d0):
            s = 0.0
        elif np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0):
            s = 3 * d0
        slope[end] = s
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    a, b = y[k], y[k + 1]
    return (1 + 2 * t) * (1 - t) ** 2 * a + t * (1 - t) ** 2 * h[k] * slope[k] + t * t * (3 - 2 * t) * b + t * t * (t - 1) * h[k] * slope[k + 1]


def resample(v: np.ndarray, n: int) -> np.ndarray:
    return pchip(np.linspace(0, n - 1, len(v)), v, np.arange(n))


def warp_supports(seed: int) -> np.ndarray:
    """Four to seven increasing supports on [0, 1], fixed by the seed."""
    rng = np.random.default_rng(seed)
    steps = np.cumsum(1 + rng.uniform(-0.5, 0.5, rng.integers(4, 8)))
    return (steps - steps[0]) / (steps[-1] - steps[0])


def distort_time(v: np.ndarray, seed: int) -> np.ndarray:
    supports, grid = warp_supports(seed), np.linspace(0, 1, len(v))
    warped = pchip(np.linspace(0, 1, len(supports)), supports, grid)
    return pchip(warped, v, grid)


def bounds_valid(v: np.ndarray) -> bool:
    return bool((np.cumsum(v) <= 0).all() and (np.cumsum(v[::-1]) <= 0).all())


def quarter_sine(v: np.ndarray, safety: float = 1.001) -> np.ndarray:
    """Lowers the start of a series by a falling quarter cosine until its largest prefix sum is gone."""
    energy = np.cumsum(v)
    if (energy <= 0).all():
        return v
    peak = int(energy.argmax())
    ramp = np.cos(np.linspace(0, np.pi / 2, peak + 1))
    out = v.copy()
    out[: peak + 1] -= safety * energy[peak] * ramp / ramp.sum()
    return out


def fix_bounds(v: np.ndarray) -> np.ndarray:
    """Both directions in turn until every prefix and suffix sum is at most 0, or nothing changes any more; then by largest magnitude."""
    while not bounds_valid(v):
        before, v = v, quarter_sine(quarter_sine(v)[::-1])[::-1]
        if (v == before).all():
            break
    m = np.abs(v).max()
    return v / m if m else v


def average_linkage(dissimilarity: np.ndarray, height: float) -> np.ndarray:
    """Cluster labels from average linkage cut at a height; labels count from 1 in order of the smallest member."""
    n = len(dissimilarity)
    d, size = dissimilarity.astype(float).copy(), np.ones(n)
    np.fill_diagonal(d, np.inf)
    label = np.arange(n)
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        if d[i, j] > height:
            break
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    _, first = np.unique(label, return_index=True)
    rank = {label[f]: k + 1 for k, f in enumerate(sorted(first))}
    return np.array([rank[x] for x in label])


def acf(v: np.ndarray) -> np.ndarray:
    x = v - v.mean()
    n = 1 << (2 * len(x) - 1).bit_length()
    f = np.fft.rfft(x, n)
    r = np.fft.irfft(f * np.conj(f), n)[: len(x)]
    return r / r[0] if r[0] > 0 else np.zeros(len(x))


def spectrum_features(v: np.ndarray) -> dict[str, float]:
    """fund_freq, freq_mean, freq_roll_on, low_fifth_power from the periodogram; frequencies from 0 to 0.5."""
    power, freq = np.abs(np.fft.rfft(v - v.mean())) ** 2, np.fft.rfftfreq(len(v))
    whole = power.sum()
    if not whole:
        return {"fund_freq": 0.0, "freq_mean": 0.0, "freq_roll_on": 0.0, "low_fifth_power": 0.0}
    share = np.cumsum(power) / whole
    return {"fund_freq": float(freq[1 + power[1:].argmax()]), "freq_mean": float((freq * power).sum() / whole), "freq_roll_on": float(freq[np.searchsorted(share, 0.05)]), "low_fifth_power": float(power[: max(1, len(power) // 5)].sum() / whole)}


def fluctuation(v: np.ndarray, rescaled_range: bool = False) -> float:
    """Share of log-spaced scales in the first regime of the best fit of log fluctuation by two lines."""
    y, n = np.cumsum(v - v.mean()), len(v)
    scales = np.unique(np.round(np.geomspace(5, max(6, n // 2), 30)).astype(int))
    out = []
    for s in scales:
        parts = y[: n // s * s].reshape(-1, s)
        x = np.arange(s) - (s - 1) / 2
        flat = parts - parts.mean(axis=1, keepdims=True) - (parts @ x / (x @ x))[:, None] * x
        out.append((np.ptp(flat, axis=1).mean() if rescaled_range else np.sqrt((flat**2).mean())) + 1e-12)
    lx, ly = np.log(scales), np.log(out)
    cost = lambda a, b: 0.0 if b - a < 2 else float(((ly[a:b] - np.polyval(np.polyfit(lx[a:b], ly[a:b], 1), lx[a:b])) ** 2).sum())
    if len(scales) < 8:
        return 1.0
    cut = min(range(4, len(scales) - 3), key=lambda k: cost(0, k) + cost(k, len(scales)))
    return cut / len(scales)
