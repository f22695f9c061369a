"""Correlations of many columns by partial Gram matrices.

Each task holds its rows of all columns as a matrix, a batch at a time, and adds up the products that a correlation needs: of the columns with the transforms of
the columns, and with which of them have a value, so a pair is judged by the rows where both have one. A task hands on one row a pair and transform, and these
are added up. The plan has the same size for any number of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Transforms of the second column of a pair.
KINDS: tuple[Callable[[np.ndarray], np.ndarray], ...] = (lambda x: x, np.sqrt, np.square, lambda x: 1 / (x + 1e-10))
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _products(x: np.ndarray, kinds: tuple) -> np.ndarray:
    """(kind, sum, i, j): the six sums of column i with the transform of column j over a batch's rows."""
    out = np.empty((len(kinds), 6, x.shape[1], x.shape[1]))
    has = np.isfinite(x)
    a = np.where(has, x, 0.0)
    for k, change in enumerate(kinds):
        with np.errstate(all="ignore"):
            y = change(x)
        both = has & np.isfinite(y)
        b, m, h = np.where(both, y, 0.0), both.astype(float), has.astype(float)
        for s, (left, right) in enumerate(((h, m), (a, m), (h, b), (a * a, m), (h, b * b), (a, b))):
            out[k, s] = left.T @ right
    return out


def pair_sums(df: DataFrame, columns: list[str], kinds: tuple = KINDS, tasks: int | None = None) -> DataFrame:
    """i, j, kind and the six sums for i before j. A null, NaN or infinite value is none, and so is a transform's."""
    n = len(columns)
    i, j = np.triu_indices(n, 1)
    names = ["i", "j", "kind", *_SUMS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kinds), 6, n, n))
        for batch in batches:
            total += _products(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1), kinds)
        for k in range(len(kinds)):
            sums = [pa.array(total[k, s][i, j]) for s in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), k), pa.int32()), *sums], names=names)

    rows = df.select([F.col(c).cast("double") for c in columns])
    # a row a pair leaves every task, so there are no more tasks than the cluster runs in a few waves
    few = rows.coalesce(tasks or 4 * df.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(run, "i int, j int, kind int, " + ", ".join(f"{s} double" for s in _SUMS))
    return parts.groupBy("i", "j", "kind").agg(*[F.sum(s).alias(s) for s in _SUMS])


def largest_correlations(df: DataFrame, columns: list[str], kinds: tuple = KINDS) -> DataFrame:
    """fi, fj, r for fi before fj: the largest |corr| of fi with fj's transforms; null where no transform has a spread."""
    s = F.col
    spread = lambda a, aa: s("n") * s(aa) - s(a) * s(a)
    r = F.abs(F.try_divide(s("n") * s("xy") - s("x") * s("y"), F.sqrt(F.greatest(spread("x", "xx") * spread("y", "yy"), F.lit(0.0)))))
    found = pair_sums(df, columns, kinds).groupBy("i", "j").agg(F.max(r).alias("r"))
    names = F.array(*map(F.lit, columns))
    return found.select(F.get(names, s("i")).alias("fi"), F.get(names, s("j")).alias("fj"), "r")
