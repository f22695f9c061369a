"""Series functions as column expressions over array<double>: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    return total(v) / F.nullif(F.size(v), F.lit(0))


def max_abs(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x)))


def norm_maxabs(v: Column) -> Column:
    """x / max|x|; a series of zeros is an error, as the division is."""
    return let(v, lambda w: let(max_abs(w), lambda m: F.transform(w, lambda x: x / m)))


def norm_meanmaxabs(v: Column) -> Column:
    return let(v, lambda w: let(mean(w), lambda m: norm_maxabs(F.transform(w, lambda x: x - m))))


def norm_zscore(v: Column) -> Column:
    spread = lambda w, m: F.sqrt(mean(F.transform(w, lambda x: (x - m) * (x - m))))
    return let(v, lambda w: let(mean(w), lambda m: let(spread(w, m), lambda s: F.transform(w, lambda x: (x - m) / s))))


def norm_minmax(v: Column) -> Column:
    return let(v, lambda w: let(F.array_min(w), lambda lo: let(F.array_max(w) - lo, lambda span: F.transform(w, lambda x: (x - lo) / span))))


def shift(v: Column, by: float | Column) -> Column:
    return norm_maxabs(F.transform(v, lambda x: x + by))


def expand(v: Column, power: float | Column) -> Column:
    """|x|^power with the sign kept: above 1 it expands, below 1 it compresses."""
    return norm_maxabs(F.transform(v, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(power))))


def _between_ends(v: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    return let(v, lambda w: let(F.array_min(w), lambda lo: let(F.array_max(w) - lo, lambda span: body(w, lo, span))))


def curtail_top(v: Column, c: float | Column) -> Column:
    return norm_maxabs(_between_ends(v, lambda w, lo, span: let((F.lit(1.0) - c) * span + lo, lambda cap: F.transform(w, lambda x: F.least(x, cap)))))


def curtail_bottom(v: Column, c: float | Column) -> Column:
    return norm_maxabs(_between_ends(v, lambda w, lo, span: let(F.lit(c) * span + lo, lambda floor: F.transform(w, lambda x: F.greatest(x, floor)))))


def curtail_middle(v: Column, c: float | Column) -> Column:
    """What exceeds the upper edge moves down by it if positive, what is under the lower edge up by it if negative; the rest becomes the middle."""

    def band(w: Column, lo: Column, span: Column) -> Column:
        low, high = (F.lit(1.0) - c) / 2 * span + lo, (F.lit(1.0) + c) / 2 * span + lo
        above = lambda x, h: F.when((x > h) & (x > 0), x - h).otherwise(F.lit(0.0))
        below = lambda x, b: F.when((x < b) & (x < 0), x - b).otherwise(F.lit(0.0))
        return let(low, lambda b: let(high, lambda h: F.transform(w, lambda x: above(x, h) + below(x, b) + (b + h) / 2)))

    return norm_maxabs(_between_ends(v, band))


def invert(v: Column, sign: float | Column = -1.0) -> Column:
    return F.transform(v, lambda x: F.when(F.lit(sign) == 1.0, x).otherwise(-x))


def smooth_ends(v: Column, overlap: int, which: str = "both") -> Column:
    """Linear ramps over `overlap` points at the start, the end or both."""
    if which not in ("start", "end", "both"):
        raise ValueError(f"which is start, end or both, not {which!r}")
    step = 1.0 / (overlap + 1)

    def ramp(x: Column, i: Column, n: Column) -> Column:
        up = F.least(F.lit(1.0), (i + 1) * step) if which != "end" else F.lit(1.0)
        down = F.least(F.lit(1.0), (n - i) * step) if which != "start" else F.lit(1.0)
        return x * up * down

    return let(v, lambda w: let(F.size(w), lambda n: F.transform(w, lambda x, i: ramp(x, i, n))))


def append_overlapping(a: Column, b: Column, overlap: int) -> Column:
    """a, then b, with the last points of a and the first of b added where they overlap."""
    both = F.zip_with(F.slice(a, -overlap, overlap), F.slice(b, 1, overlap), lambda x, y: x + y)
    return F.concat(F.slice(a, F.lit(1), F.size(a) - overlap), both, F.slice(b, F.lit(overlap + 1), F.greatest(F.size(b) - overlap, F.lit(0))))


def fix_mean(v: Column, tol: float = 0.01, draws: tuple[float | Column, float | Column] | None = None) -> Column:
    """A mean of at least tol turns the series over; one within tol moves down by twice tol and a draw of at least tol, and is looked at again.

    A series of magnitude 1 leaves the band with one move, as it moves by three times tol at least and by little more in scale; one that is larger is
    of magnitude 1 after the first, so two moves do for any. draws: of both moves, tol each unless given.
    """

    def step(w: Column, u: float | Column) -> Column:
        turned = lambda m: F.when(m <= -tol, w).when(m >= tol, F.transform(w, lambda x: -x))
        return let(mean(w), lambda m: turned(m).otherwise(norm_maxabs(F.transform(w, lambda x: x - 2 * tol - u))))

    first, second = draws or (tol, tol)
    return let(v, lambda w: let(step(w, first), lambda x: step(x, second)))


def fix_sign_negative(v: Column) -> Column:
    return let(v, lambda w: let(F.array_max(w), lambda m: F.when(m <= 0, w).otherwise(norm_maxabs(F.transform(w, lambda x: x - F.greatest(m, F.lit(0.0)))))))


def tile(v: Column, times: int, length: int) -> Column:
    return F.slice(F.flatten(F.array_repeat(v, times)), 1, length)
