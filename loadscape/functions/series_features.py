"""Features of a series as expressions over its array of values: a row in, a row out, with no window, join or shuffle.

A feature names the parts it needs (differences, sorted values, autocorrelations, ...), which are computed once a row and shared by all features that ask
for them. Features without a value (of an empty or, for some, a constant series) are null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loadscape.functions import arrays as A

Parts = Callable[[str], Column]


@dataclass(frozen=True)
class Feature:
    needs: tuple[str, ...]
    build: Callable[..., Column]  # of the parts and the settings
    settings: dict[str, float] = field(default_factory=dict)
    count: bool = False  # a whole number


FEATURES: dict[str, Feature] = {}

#: Parts by name: what they need, and how they follow from it; "v" is the series.
PARTS: dict[str, tuple[tuple[str, ...], Callable[[Parts], Column]]] = {
    "n": ((), lambda p: F.size(p("v"))),
    "mean": ((), lambda p: A.mean(p("v"))),
    "lo": ((), lambda p: F.array_min(p("v"))),
    "hi": ((), lambda p: F.array_max(p("v"))),
    "arv": ((), lambda p: A.mean(F.transform(p("v"), lambda x: F.abs(x)))),
    "rms": ((), lambda p: F.sqrt(A.mean(F.transform(p("v"), lambda x: x * x)))),
    "peak": ((), lambda p: A.max_abs(p("v"))),
    "root": ((), lambda p: A.mean(F.transform(p("v"), lambda x: F.sqrt(F.abs(x))))),
    "sorted": ((), lambda p: F.array_sort(p("v"))),
    "d": (("n",), lambda p: F.zip_with(F.slice(p("v"), 2, F.greatest(p("n") - 1, F.lit(0))), F.slice(p("v"), 1, F.greatest(p("n") - 1, F.lit(0))), lambda b, a: b - a)),
    "d sorted": (("d",), lambda p: F.array_sort(p("d"))),
    "d abs": (("d",), lambda p: F.transform(p("d"), lambda x: F.abs(x))),
    "d abs sorted": (("d abs",), lambda p: F.array_sort(p("d abs"))),
    "centred": (("mean",), lambda p: F.transform(p("v"), lambda x: x - p("mean"))),
    "acf": (("n", "centred"), lambda p: _autocorrelations(p)),
    "t": (("n",), lambda p: F.transform(p("v"), lambda x, i: i.cast("double"))),
}


def _autocorrelations(p: Parts) -> Column:
    """r of the lags 1, 2, ... n - 1."""
    x, n = p("centred"), p("n")
    shifted = lambda k: A.total(F.zip_with(F.slice(x, F.lit(1), n - k), F.slice(x, k + 1, n - k), lambda a, b: a * b))
    energy = A.total(F.transform(x, lambda a: a * a))
    return A.let(energy, lambda e: F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.try_divide(shifted(k), e))))


def _feature(name: str, *needs: str, count: bool = False, **settings: float):
    def put(build: Callable[..., Column]) -> Callable[..., Column]:
        FEATURES[name] = Feature(needs, build, settings, count)
        return build

    return put


def _at(s: Column, share: float) -> Column:
    """A percentile of sorted values, interpolated; null of none."""
    at = F.lit(float(share)) * (F.size(s) - 1)
    low, high = (F.get(s, f(at).cast("int")) for f in (F.floor, F.ceil))
    return F.when(F.size(s) > 0, low + (high - low) * (at - F.floor(at)))


def _longest(flags: Column) -> Column:
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, flag: Column) -> Column:
        now = F.when(flag, s["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(flags, start, step)["best"]


def _cells(p: Parts, bins: float) -> Column:
    """Which of equal bins over the range each value is in; all are in the first if the range is empty."""
    width = F.nullif((p("hi") - p("lo")) / bins, F.lit(0.0))
    return F.transform(p("v"), lambda x: F.coalesce(F.least(F.floor((x - p("lo")) / width), F.lit(int(bins) - 1)), F.lit(0)).cast("int"))


def _counts(codes: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.size(F.filter(codes, lambda c: c == k)).cast("double"))


def _pairs(cells: Column, size: int, lag: int) -> Column:
    """Codes of each value's cell and that of the value `lag` later."""
    m = F.greatest(F.size(cells) - lag, F.lit(0))
    return F.zip_with(F.slice(cells, F.lit(1), m), F.slice(cells, F.lit(1 + lag), m), lambda a, b: a * size + b)


# ---- amplitude
_feature("arv", "arv")(lambda p: p("arv"))
_feature("crest", "peak", "rms")(lambda p: F.try_divide(p("peak"), p("rms")))
_feature("shape", "rms", "arv")(lambda p: F.try_divide(p("rms"), p("arv")))
_feature("impulse", "peak", "arv")(lambda p: F.try_divide(p("peak"), p("arv")))
_feature("clearance", "peak", "root")(lambda p: F.try_divide(p("peak"), p("root") * p("root")))

# ---- level
_feature("mean", "mean")(lambda p: p("mean"))
_feature("std", "centred")(lambda p: F.sqrt(A.mean(F.transform(p("centred"), lambda x: x * x))))
_feature("min", "lo")(lambda p: p("lo"))
_feature("max", "hi")(lambda p: p("hi"))
_feature("peak2peak", "lo", "hi")(lambda p: p("hi") - p("lo"))
_feature("share_above_mean", "mean")(lambda p: A.mean(F.transform(p("v"), lambda x: (x > p("mean")).cast("double"))))
_feature("count_above_mean", "mean")(lambda p: F.size(F.filter(p("v"), lambda x: x > p("mean"))).cast("double"))
_feature("mean_diff_from_mean", "centred")(lambda p: A.mean(F.transform(p("centred"), lambda x: F.abs(x))))
_feature("iqr", "sorted")(lambda p: _at(p("sorted"), 0.75) - _at(p("sorted"), 0.25))
_feature("quantile", "sorted", q=0.5)(lambda p, q: _at(p("sorted"), q))
_feature("cross_zero", "n", count=True)(lambda p: F.size(F.filter(F.zip_with(F.slice(p("v"), 2, F.greatest(p("n") - 1, F.lit(0))), F.slice(p("v"), 1, F.greatest(p("n") - 1, F.lit(0))), lambda b, a: F.signum(b) != F.signum(a)), lambda x: x)).cast("long"))

# ---- differences
_feature("trev", "d")(lambda p: A.mean(F.transform(p("d"), lambda x: F.pow(x, F.lit(3.0)))))
_feature("pnn40", "d abs", least=0.04)(lambda p, least: A.mean(F.transform(p("d abs"), lambda x: (x > least).cast("double"))))
_feature("mean_signed_diff", "d")(lambda p: A.mean(p("d")))
_feature("median_signed_diff", "d sorted")(lambda p: _at(p("d sorted"), 0.5))
_feature("median_abs_diff", "d abs sorted")(lambda p: _at(p("d abs sorted"), 0.5))
_feature("mean_abs_diff", "d abs")(lambda p: A.mean(p("d abs")))
_feature("mean_2nd_diff", "d")(lambda p: A.mean(F.zip_with(F.slice(p("d"), 2, F.greatest(F.size(p("d")) - 1, F.lit(0))), F.slice(p("d"), 1, F.greatest(F.size(p("d")) - 1, F.lit(0))), lambda b, a: (b - a) / 2)))

# ---- places and runs
_feature("loc_first_max", "n", "hi")(lambda p: (F.array_position(p("v"), p("hi")) - 1) / p("n"))
_feature("loc_last_max", "n", "hi")(lambda p: (p("n") - F.array_position(F.reverse(p("v")), p("hi")) + 1) / p("n"))
_feature("temporal_centroid", "t", fs=1000.0)(lambda p, fs: F.try_divide(A.total(F.zip_with(p("t"), p("v"), lambda t, x: t / fs * x * x)), A.total(F.transform(p("v"), lambda x: x * x))))
_feature("longest_above_mean", "mean", count=True)(lambda p: _longest(F.transform(p("v"), lambda x: x > p("mean"))).cast("long"))
_feature("longest_decrease", "d", count=True)(lambda p: _longest(F.transform(p("d"), lambda x: x < 0)).cast("long"))


# ---- shape of the distribution and of the course
@_feature("mode", "lo", "hi", bins=5.0)
def _mode(p: Parts, bins: float) -> Column:
    """Centre of the fullest of equal bins; ties are averaged."""
    width = (p("hi") - p("lo")) / bins
    centres = A.let(_counts(_cells(p, bins), int(bins)), lambda c: A.let(F.array_max(c), lambda most: F.transform(F.filter(F.transform(c, lambda x, i: F.when(x == most, i.cast("double"))), lambda i: i.isNotNull()), lambda i: p("lo") + (i + 0.5) * width)))
    return A.mean(centres)


_first = lambda flags: F.nullif(F.array_position(flags, F.lit(True)), F.lit(0).cast("long")).cast("int")
_feature("acf_timescale", "acf", count=True)(lambda p: _first(F.transform(p("acf"), lambda r: r < 1 / np.e)))
_feature("acf_first_zero", "acf", count=True)(lambda p: _first(F.transform(p("acf"), lambda r: r <= 0)))
_feature("acf_first_min", "acf", count=True)(lambda p: _first(F.transform(p("acf"), lambda r, i: (r < F.when(i == 0, F.lit(1.0)).otherwise(F.get(p("acf"), i - 1))) & (r < F.get(p("acf"), i + 1)))))


@_feature("linearity", "n", "t")
def _linearity(p: Parts) -> Column:
    n, t, v = p("n"), p("t"), p("v")
    product = lambda a, b: A.total(F.zip_with(a, b, lambda x, y: x * y))
    cov, vt, vv = n * product(t, v) - A.total(t) * A.total(v), n * product(t, t) - A.total(t) * A.total(t), n * product(v, v) - A.total(v) * A.total(v)
    return F.try_divide(cov * cov, vt * vv)


@_feature("mean3_stderr", "n", window=3.0)
def _forecast(p: Parts, window: float) -> Column:
    """Spread of what the mean of the points before leaves."""
    w, v = int(window), p("v")
    before = lambda i: sum((F.get(v, i + k) for k in range(1, w)), F.get(v, i)) / w
    left = F.transform(F.slice(v, w + 1, F.greatest(p("n") - w, F.lit(0))), lambda x, i: x - before(i))
    spread = lambda e: A.let(A.mean(e), lambda m: F.sqrt(A.total(F.transform(e, lambda x: (x - m) * (x - m))) / F.nullif(F.size(e) - 1, F.lit(0))))
    return A.let(left, lambda e: F.when(F.size(e) > 1, spread(e)))


@_feature("motif_entropy", "sorted")
def _motifs(p: Parts) -> Column:
    """Entropy of pairs of following letters over the terciles."""
    letters = F.transform(p("v"), lambda x: (x > _at(p("sorted"), 1 / 3)).cast("int") + (x > _at(p("sorted"), 2 / 3)).cast("int"))
    return A.let(_counts(_pairs(letters, 3, 1), 9), lambda c: A.let(A.total(c), lambda all_: F.when(all_ > 0, -A.total(F.transform(F.filter(c, lambda x: x > 0), lambda x: x / all_ * F.log(x / all_))))))


@_feature("ami2", "lo", "hi", lag=2.0, bins=5.0)
def _information(p: Parts, lag: float, bins: float) -> Column:
    """Mutual information of values `lag` apart, over equal bins of the range."""
    b = int(bins)

    def gain(c: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: A.total(F.slice(c, i * b + 1, F.lit(b))))
        columns = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda j: A.total(F.filter(c, lambda x, k: k % b == j)))
        part = lambda na, nb, all_: F.transform(c, lambda x, k: F.when(x > 0, x / all_ * F.log(x * all_ / (F.get(na, F.floor(k / b).cast("int")) * F.get(nb, k % b)))).otherwise(F.lit(0.0)))
        return A.let(A.total(c), lambda all_: F.when(all_ > 0, A.let(rows, lambda na: A.let(columns, lambda nb: A.total(part(na, nb, all_))))))

    return A.let(_counts(_pairs(_cells(p, bins), b, int(lag)), b * b), gain)
