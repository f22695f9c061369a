"""Feature spaces: histograms, heterogeneity, robust scaling, correlation, neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadscape.operators import quantiles as Q
from loadscape.operators.features import rounded
from loadscape.operators.gram import largest_correlations
from loadscape.plans.sql import EDGES
from loadscape.sources.store import kept

#: Queries and points of a block that meet in one task, queries compared at once, and blocks at most.
QUERIES, POINTS, SLICE, BLOCKS = 16_384, 16_384, 64, 4096


def unpivoted(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    return df.unpivot(list(keep), columns, "feature", "v")


def bin_of(v: Column, edges: list[float] = EDGES) -> Column:
    """Left-closed bin: how many interior edges are at most v; null outside [0, 1]."""
    count = sum(((v >= e).cast("int") for e in edges[1:]), (v >= edges[0]).cast("int"))
    return F.when(v.between(0.0, 1.0), count)


def decile_right_closed(v: Column) -> Column:
    return sum(((v > e).cast("int") for e in EDGES[1:]), (v > EDGES[0]).cast("int"))


def nd_hist(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(by, feature, bin, freq) with every bin, relative to all rows."""
    long = unpivoted(df, columns, *by)
    totals = long.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"))
    counts = long.withColumn("bin", bin_of(F.col("v"))).filter("bin is not null").groupBy(*by, "feature", "bin").agg(F.count(F.lit(1)).alias("c"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(EDGES)))))
    return grid.join(counts, [*by, "feature", "bin"], "left").select(*by, "feature", "bin", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("freq"))


def heterogeneity(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """0 if every feature fills its bins evenly, 1 if each sits in one bin."""
    b = len(EDGES) + 1
    h = nd_hist(df, columns, *by).groupBy(*by, "feature").agg((F.sqrt(F.sum(F.pow(F.col("freq") - 1.0 / b, F.lit(2.0)))) / F.sqrt(F.lit(1 - 1.0 / b))).alias("h"))
    return h.groupBy(*by).agg(rounded(F.avg("h")).alias("heterogeneity"))


def set_info(sets: DataFrame, columns: list[str]) -> DataFrame:
    """Heterogeneity of each set and of each of its kinds: (set_size, part, heterogeneity), part being 'both' or a kind; sets has set_size and kind."""
    return heterogeneity(sets.withColumn("part", F.explode(F.array(F.lit("both"), "kind"))), columns, "set_size", "part")


def _of(df: DataFrame, columns: list[str], change: Callable[[str], Column]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in columns], *[change(c).alias(c) for c in columns])


def sigmoid(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 / (1 + exp(-(x - median) / (1.35 iqr))), with exact quartiles."""
    q = {c: [F.lit(x).cast("double") for x in found] for c, found in Q.of_columns(df, columns, (0.25, 0.5, 0.75)).items()}
    return _of(df, columns, lambda c: 1 / (1 + F.exp(-(F.col(c) - q[c][1]) / (1.35 * (q[c][2] - q[c][0]) + 1e-12))))


def clip_at_whiskers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Clip to the outermost points within 1.5 iqr of the quartiles."""
    ends = []
    for c, (a, b) in Q.of_columns(df, columns, (0.25, 0.75)).items():
        lo, hi = (F.lit(x).cast("double") for x in ((None, None) if a is None else (a - 1.5 * (b - a), b + 1.5 * (b - a))))
        ends += [F.min(F.when(F.col(c) >= lo, F.col(c))).alias(f"{c}_lo"), F.max(F.when(F.col(c) <= hi, F.col(c))).alias(f"{c}_hi")]
    found = df.agg(*ends).first()
    end = lambda c, which: F.lit(found[f"{c}_{which}"]).cast("double")
    return _of(df, columns, lambda c: F.least(F.greatest(F.col(c), end(c, "lo")), end(c, "hi")))


def between_extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to [0, 1] by its own extremes, found first; a constant column becomes null."""
    found = df.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    lo, width = ({c: F.lit(x).cast("double") for c, x in pairs} for pairs in ([(c, found[f"{c}_lo"]) for c in columns], [(c, None if found[f"{c}_lo"] is None else (found[f"{c}_hi"] - found[f"{c}_lo"]) or None) for c in columns]))
    return _of(df, columns, lambda c: (F.col(c) - lo[c]) / width[c])


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sigmoid, whiskers, min-max. The rows are kept once; each statistic is a few aggregates over the columns, and what they find are constants in one projection."""
    return between_extremes(clip_at_whiskers(sigmoid(kept(df, "space"), columns), columns), columns)


def modified_pearson(df: DataFrame, columns: list[str], method: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(fi, fj, r) for fi before fj in the given order: the largest |corr| of fi with fj, its root, square and inverse; or what an own aggregate of two columns says."""
    if method is None:
        found = largest_correlations(df, columns)
    else:
        pairs = [F.struct(F.lit(a).alias("fi"), F.lit(b).alias("fj"), method(F.col(a), F.col(b)).alias("r")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
        found = df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))
    return found.select("fi", "fj", rounded(F.col("r")).alias("r"))


def correlation_matrix(df: DataFrame, columns: list[str], method: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(fi, fj, r), symmetric and with the diagonal."""
    upper = modified_pearson(df, columns, method)
    diagonal = upper.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "fi string, fj string, r double")
    return upper.unionByName(upper.select(F.col("fj").alias("fi"), F.col("fi").alias("fj"), "r")).unionByName(diagonal)


def cluster_correlations(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """feature, label, inner_corr (mean over the own cluster, itself included), outer_corr (over all others); labels: feature, label."""
    m = matrix.join(labels.select(F.col("feature").alias("fi"), F.col("label").alias("li")), "fi").join(labels.select(F.col("feature").alias("fj"), F.col("label").alias("lj")), "fj")
    same = F.col("li") == F.col("lj")
    return m.groupBy(F.col("fi").alias("feature"), F.col("li").alias("label")).agg(F.round(F.avg(F.when(same, F.col("r"))), 9).alias("inner_corr"), F.round(F.avg(F.when(~same, F.col("r"))), 9).alias("outer_corr"))


def first_per_cluster(info: DataFrame) -> DataFrame:
    """Each label's first feature in the order inner_corr falling, outer_corr rising, name."""
    w = Window.partitionBy("label").orderBy(F.col("inner_corr").desc(), F.col("outer_corr").asc(), "feature")
    return info.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("label", "feature")


def cluster_summary(info: DataFrame) -> DataFrame:
    """mean, std, min and max of inner_corr by label."""
    return info.groupBy("label").agg(*[F.round(f("inner_corr"), 9).alias(f"inner_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


def cluster_statistics(info: DataFrame) -> DataFrame:
    """label, feature (its cluster's first), and mean, std, min and max of inner_corr and outer_corr by label; in a row without a label the same over the clusters' means."""
    of = lambda column, name: [F.round(f(column), 9).alias(f"{name}_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    by_label = info.groupBy("label").agg(*of("inner_corr", "inner"), *of("outer_corr", "outer"))
    over = by_label.agg(*of("inner_mean", "inner"), *of("outer_mean", "outer")).withColumn("label", F.lit(None).cast("int")).withColumn("feature", F.lit(None).cast("string"))
    return by_label.join(first_per_cluster(info), "label").unionByName(over)


def cells(df: DataFrame, columns: list[str], n: int, dense: bool = False) -> DataFrame:
    """The n emptiest (or fullest) cells of the histogram."""
    freq = F.col("freq").desc() if dense else F.col("freq").asc()
    return nd_hist(df, columns).withColumn("freq", rounded(F.col("freq"))).orderBy(freq, "feature", "bin").limit(n)


def nearest(queries: DataFrame, points: DataFrame, columns: list[str], k: int, p: float = 2.0) -> DataFrame:
    """(q_id, rank, ts_id, dist): the k nearest other points in Minkowski distance; ties to the smaller id.

    Points are dealt to blocks around pivots, and of each block the box around its points is known. A query first meets the nearest
    boxes that hold k points besides itself, and then those others that lie no farther than its k-th distance so far; a block of many points, or one that many queries
    meet, is split by hashes. Rows with a coordinate that is null or no number are nobody's neighbour and have none. Ids are unique.
    """
    own = [f"_c{i}" for i in range(len(columns))]
    known = lambda df: df.select(F.col("ts_id").cast("long").alias("ts_id"), *[F.col(c).cast("double").alias(o) for c, o in zip(columns, own)]).filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in own]))
    q, pts = kept(known(queries), "near-queries"), kept(known(points), "near-points")
    n_blocks = min(BLOCKS, -(-pts.count() // POINTS))
    if not n_blocks:
        return q.select(F.col("ts_id").alias("q_id"), F.lit(0).alias("rank"), "ts_id", F.lit(0.0).alias("dist")).limit(0)
    columns = own
    # at most BLOCKS pivots and boxes; they steer the work, not the result
    pivots = np.array([[r[c] for c in columns] for r in pts.orderBy(F.xxhash64("ts_id")).limit(n_blocks).collect()])
    pts = kept(_dealt(pts, columns, pivots), "near-points")
    boxes = pts.groupBy("b").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{e}") for c in columns for e, f in (("lo", F.min), ("hi", F.max))]).orderBy("b").toPandas()
    size = np.zeros(n_blocks, int)
    size[boxes["b"]] = boxes["n"]
    pts = pts.withColumn("ps", F.pmod(F.xxhash64("ts_id"), _by_block(-(-size // POINTS))).cast("int"))
    first = kept(_met(q, pts, columns, k, p, size, _visits(q, columns, boxes, k, p)), "near-first")
    best = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "ts_id"))).filter(F.col("rank") <= k)
    found = first
    if n_blocks > 1:
        reach = best(first).filter(F.col("rank") == k).select("q_id", F.col("dist").alias("reach"))
        again = q.join(reach.withColumnRenamed("q_id", "ts_id"), "ts_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        found = first.unionByName(_met(q, pts, columns, k, p, size, _visits(again, columns, boxes, k, p)))
    return best(found).select("q_id", "rank", "ts_id", rounded(F.col("dist")).alias("dist"))


def _by_block(numbers: np.ndarray) -> Column:
    """A number for each block, 1 at least, looked up by b."""
    return F.element_at(F.array(*[F.lit(max(1, int(x))) for x in numbers]), F.col("b") + 1)


def _dealt(points: DataFrame, columns: list[str], pivots: np.ndarray) -> DataFrame:
    """points with b, the pivot that is nearest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x, b = part[columns].to_numpy(), np.zeros(len(part), np.int32)
            for i in range(0, len(x), SLICE):
                b[i : i + SLICE] = ((x[i : i + SLICE, None] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1)
            yield part.assign(b=b)

    return points.mapInPandas(run, "ts_id long, " + ", ".join(f"{c} double" for c in columns) + ", b int")


def _visits(queries: DataFrame, columns: list[str], boxes: pd.DataFrame, k: int, p: float) -> DataFrame:
    """ts_id and b: the blocks that each query meets first; with a column reach, the others whose box lies within it."""
    blocks, n = boxes["b"].to_numpy(), boxes["n"].to_numpy()
    lo, hi = (boxes[[f"{c}_{e}" for c in columns]].to_numpy() for e in ("lo", "hi"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x, ids = part[columns].to_numpy(), part["ts_id"].to_numpy()
            for i in range(0, len(x), SLICE):
                some = x[i : i + SLICE, None]
                gap = (np.maximum(np.maximum(lo[None] - some, some - hi[None]), 0) ** p).sum(axis=2) ** (1 / p)
                order = np.argsort(gap, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                take = np.zeros_like(gap, bool)
                np.put_along_axis(take, order, before <= k, axis=1)  # k points, and perhaps the query itself
                if "reach" in part:
                    # a little wider than rounding makes distances differ
                    take = ~take & (gap <= part["reach"].to_numpy()[i : i + SLICE, None] * (1 + 1e-9) + 1e-12)
                row, at = np.nonzero(take)
                yield pd.DataFrame({"ts_id": ids[i : i + SLICE][row], "b": blocks[at]})

    return queries.mapInPandas(run, "ts_id long, b int")


def _met(q: DataFrame, pts: DataFrame, columns: list[str], k: int, p: float, size: np.ndarray, visits: DataFrame) -> DataFrame:
    """q_id, ts_id, dist: of each block that queries visit, k rows a query."""
    visits = kept(visits, "near-visits")
    many = np.zeros(len(size), int)
    for r in visits.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a block
        many[r["b"]] = r["n"]
    parts = lambda numbers: F.explode(F.sequence(F.lit(0), _by_block(numbers) - 1))
    n_q, n_p = -(-many // QUERIES), -(-size // POINTS)
    left = visits.withColumn("qs", F.pmod(F.xxhash64("ts_id", F.lit("q")), _by_block(n_q)).cast("int")).withColumn("ps", parts(n_p)).join(q, "ts_id")
    right = pts.filter(_by_block(np.where(many > 0, 2, 1)) == 2).withColumn("qs", parts(n_q))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _block_nearest(a, b, columns, k, p)

    key = ["b", "qs", "ps"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "q_id long, ts_id long, dist double")


def _block_nearest(queries: pd.DataFrame, points: pd.DataFrame, columns: list[str], k: int, p: float) -> pd.DataFrame:
    """k rows a query from one block of points, by SLICE queries at a time."""
    points = points.sort_values("ts_id")
    ids, at, found = points["ts_id"].to_numpy(), points[columns].to_numpy(), []
    for i in range(0, len(queries), SLICE) if len(points) else ():
        some = queries.iloc[i : i + SLICE]
        q_ids, q = some["ts_id"].to_numpy(), some[columns].to_numpy()
        gap = np.zeros((len(q), len(at)))
        for j in range(len(columns)):
            gap += np.abs(at[:, j] - q[:, j : j + 1]) ** p
        dist = gap ** (1 / p)
        dist[q_ids[:, None] == ids] = np.inf
        last = np.partition(dist, min(k, len(at)) - 1, axis=1)[:, min(k, len(at)) - 1 : min(k, len(at))]
        row, col = np.nonzero((dist <= last) & (dist < np.inf))
        order = np.lexsort((ids[col], dist[row, col], row))
        row, col = row[order], col[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append(pd.DataFrame({"q_id": q_ids[row], "ts_id": ids[col], "dist": dist[row, col]})[first])
    return pd.concat(found) if found else pd.DataFrame({"q_id": [], "ts_id": [], "dist": []})
