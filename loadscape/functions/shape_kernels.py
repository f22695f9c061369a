"""Kernels of features that need fits, decompositions or searches over lags; each works on one series.

Features known by name only are defined here: change points from smoothed differences (rcp_num), from run-length
posteriors (bocp_conf_max), and a periodic seasonal decomposition (stl_*). A series too short for a feature gives nan.
"""

from __future__ import annotations

import numpy as np

from loadscape.functions.kernels import acf

PERIOD, SHORTEST = 7, 12
NAMES = ("transition_variance", "periodicity", "embed_dist", "ami_timescale", "residual_timescale_ratio", "outlier_timing_pos", "outlier_timing_neg", "rcp_num", "bocp_conf_max", "stl_seasonality_strength", "stl_spikiness", "stl_peak", "stl_trough")


def first_zero(r: np.ndarray) -> int:
    """First lag with autocorrelation at or under 0; the length if there is none."""
    under = np.flatnonzero(r <= 0)
    return int(under[0]) if len(under) else len(r)


def transition_variance(v: np.ndarray, tau: int, letters: int = 3) -> float:
    """Summed column variances of the transition frequencies between quantile letters of every tau-th point."""
    x = v[:: max(1, tau)]
    if len(x) < 2:
        return np.nan
    letter = np.searchsorted(np.quantile(x, np.arange(1, letters) / letters), x)
    moves = np.bincount(letter[:-1] * letters + letter[1:], minlength=letters * letters).reshape(letters, letters) / (len(x) - 1)
    return float(moves.var(axis=0, ddof=1).sum())


def periodicity(v: np.ndarray, rise: float = 0.01) -> float:
    """First lag where the autocorrelation without a two-piece cubic trend peaks above 0 and by `rise` above the trough before; else 0."""
    t = np.linspace(-1, 1, len(v))
    basis = np.column_stack([np.ones(len(v)), t, t**2, t**3, np.maximum(t, 0) ** 3])
    rest = v - basis @ np.linalg.lstsq(basis, v, rcond=None)[0]
    if rest.std() < 1e-9 * v.std():  # rounding only
        return 0.0
    r = acf(rest)[: len(v) // 3 + 1]
    turn = np.diff(np.sign(np.diff(r)))
    trough = np.nan
    for lag in np.flatnonzero(turn) + 1:
        if turn[lag - 1] > 0:
            trough = r[lag]
        elif r[lag] > 0 and r[lag] - trough >= rise:
            return float(lag)
    return 0.0


def embedding_distance(v: np.ndarray, tau: int) -> float:
    """Mean absolute gap between the histogram of steps in the plane (x_t, x_{t+tau}) and an exponential of their mean."""
    tau = max(1, min(tau, len(v) // 10))
    step = np.diff(v)
    d = np.hypot(step[:-tau], step[tau:])
    spread = d.std(ddof=1)
    if not spread > 1e-3 * d.mean():
        return np.nan
    bins = max(1, int(np.ceil(np.ptp(d) / (3.5 * spread / len(d) ** (1 / 3)))))
    share, edge = np.histogram(d, bins)
    centre, mean = (edge[:-1] + edge[1:]) / 2, d.mean()
    return float(np.abs(share / len(d) - np.exp(-centre / mean) / mean).mean())


def information_minimum(v: np.ndarray, most: int = 40) -> float:
    """First lag at which Gaussian mutual information has a local minimum; the last lag looked at if there is none."""
    lags = range(1, min(most, (len(v) + 1) // 2) + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        info = np.array([-0.5 * np.log1p(-np.corrcoef(v[:-k], v[k:])[0, 1] ** 2) for k in lags])
    low = np.flatnonzero((info[1:-1] < info[:-2]) & (info[1:-1] < info[2:]))
    return float(low[0] + 2) if len(low) else float(len(info))


def outlier_timing(v: np.ndarray, sign: int, step: float = 0.01, least: float = 0.02) -> float:
    """Median, over rising thresholds, of the median place (-1 to 1) of points beyond; thresholds under which `least` of all are beyond do not count."""
    x = sign * (v - v.mean()) / v.std()
    by = np.argsort(-x, kind="stable")
    counts = np.searchsorted(-x[by], -np.arange(0, x.max(), step), side="right")
    counts = counts[counts > least * len(x)]
    medians = {c: np.median(by[:c]) for c in np.unique(counts)}
    return float(np.median([medians[c] for c in counts]) / ((len(x) - 1) / 2) - 1) if len(counts) else 0.0


def robust_changes(v: np.ndarray, width: int = 5, z: float = 2.807) -> float:
    """Runs of differences, `width` apart, of the moving mean that lie z standard deviations out (two-sided 0.005)."""
    smooth = np.convolve(v, np.full(width, 1 / width), "valid")
    d = smooth[width:] - smooth[:-width]
    if len(d) < 2 or not d.std() > 0:
        return 0.0
    out = np.abs(d - d.mean()) > z * d.std()
    return float(np.count_nonzero(np.diff(out.astype(int), prepend=0) == 1))


def change_confidence(v: np.ndarray, hazard: float = 0.01, lag: int = 10) -> float:
    """Largest posterior probability, `lag` points later, that a run began at a point (Bayesian online detection, normal with known noise)."""
    x = (v - v.mean()) / v.std()
    noise = max(float(np.diff(x).var()) / 2, 1e-6)
    run, mean, precision, best = np.ones(1), np.zeros(1), np.ones(1), 0.0
    for t, value in enumerate(x):
        var = noise + 1 / precision
        log = -0.5 * (np.log(var) + (value - mean) ** 2 / var)
        grown = run * np.exp(log - log.max())
        run = np.append(hazard * grown.sum(), (1 - hazard) * grown)
        run /= run.sum()
        after = precision + 1 / noise
        mean, precision = np.append(0.0, (precision * mean + value / noise) / after), np.append(1.0, after)
        if t > lag:
            best = max(best, float(run[lag]))
    return best


def loess(v: np.ndarray, width: int) -> np.ndarray:
    """Local lines with tricube weights over the nearest `width` points of a regular grid."""
    n = len(v)
    width = min(width, n)
    start = np.clip(np.arange(n) - width // 2, 0, n - width)
    at = start[:, None] + np.arange(width)
    x = (at - np.arange(n)[:, None]).astype(float)
    w = (1 - np.minimum(np.abs(x) / (np.abs(x).max(axis=1, keepdims=True) + 1), 1) ** 3) ** 3
    w /= w.sum(axis=1, keepdims=True)
    y, mx = v[at], (w * x).sum(axis=1, keepdims=True)
    slope = (w * (x - mx) * y).sum(axis=1) / np.maximum((w * (x - mx) ** 2).sum(axis=1), 1e-12)
    return (w * y).sum(axis=1) - slope * mx[:, 0]


def decompose(v: np.ndarray, period: int = PERIOD, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal part (the same in each period) and remainder: means of the phases and loess trends in turn."""
    phase, width = np.arange(len(v)) % period, int(1.5 * period / (1 - 1.5 / (10 * period + 1))) | 1
    trend = np.zeros(len(v))
    for _ in range(rounds):
        mean = np.bincount(phase, v - trend) / np.bincount(phase)
        season = (mean - mean.mean())[phase]
        trend = loess(v - season, width)
    return trend, season, v - trend - season


def leave_one_out(r: np.ndarray) -> np.ndarray:
    """Variance of the others, for each value."""
    n = len(r)
    mean = (r.sum() - r) / (n - 1)
    return ((r**2).sum() - r**2 - (n - 1) * mean**2) / (n - 2)


def shape_features(v: np.ndarray) -> dict[str, float]:
    """All of NAMES; nan for a constant series or one of under SHORTEST points."""
    v = np.asarray(v, float)
    if len(v) < SHORTEST or not np.isfinite(v).all() or not v.std() > 0:
        return dict.fromkeys(NAMES, np.nan)
    tau = first_zero(acf(v))
    _, season, rest = decompose(v)
    both = float((season + rest).var())
    one = season[:PERIOD]
    values = (
        transition_variance(v, tau),
        periodicity(v),
        embedding_distance(v, tau),
        information_minimum(v),
        first_zero(acf(np.diff(v))) / tau,
        outlier_timing(v, 1),
        outlier_timing(v, -1),
        robust_changes(v),
        change_confidence(v),
        max(0.0, 1 - float(rest.var()) / both) if both else 0.0,
        float(leave_one_out(rest).var()),
        float(one.argmax()),
        float(one.argmin()),
    )
    return {k: x if np.isfinite(x) else np.nan for k, x in zip(NAMES, values)}
