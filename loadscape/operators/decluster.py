"""Small sets that cover a feature space evenly.

The pool stays distributed; what reaches the driver is a set of fixed size, the ids and some neighbours of the rows of which the closest are removed,
or the pool's bin numbers for the greedy exchange, of which a sample of at most POOL rows takes part beside the chosen ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscape.functions import halton
from loadscape.functions import linkage as L
from loadscape.operators.ordered import of_all
from loadscape.operators.space import correlation_matrix, decile_right_closed, nearest
from loadscape.plans.sql import EDGES
from loadscape.sources.store import kept

OFFSET, POOL, NEIGHBOURS = 1_000_000, 1 << 18, 1 << 21


def with_kind(df: DataFrame) -> DataFrame:
    """Even labels are one population, odd ones the other, whose ids are moved by OFFSET."""
    neg = F.col("label") % 2 == 0
    return df.withColumn("kind", F.when(neg, "only_neg").otherwise("only_posneg")).withColumn("ts_id", F.col("ts_id") + F.when(neg, 0).otherwise(OFFSET))


def sample(df: DataFrame, n: int, seed: int = 12345) -> DataFrame:
    """n rows by the order of a generator over the id: the same rows however df is partitioned."""
    # the id is reduced first, which leaves the order as it is and keeps the product of any id within a long
    order = (F.pmod(F.col("ts_id"), F.lit(2147483648)) * 1103515245 + seed) % 2147483648
    return df.orderBy(order, "ts_id").limit(n)


def sort_nested(df: DataFrame) -> DataFrame:
    """(ts_id, set_cluster, mean_cluster, pos): smaller sets first, then the decile of the mean falling, then iqr, then id."""
    d = df.select("ts_id", "set_cluster", decile_right_closed(F.col("mean")).alias("mean_cluster"), "iqr")
    placed = of_all(d, F.col("set_cluster").desc(), F.col("mean_cluster").desc(), F.col("iqr").asc(), F.col("ts_id").asc())
    return placed.select("ts_id", "set_cluster", "mean_cluster", F.col("pos").cast("long").alias("pos"))


def within_volume(found: DataFrame) -> DataFrame:
    """Nearest neighbours (q_id, ts_id, dist) without those farther than 1.2 times the bound of the well-filled distances.

    The bound is the third quartile of the right edges of the bins (half as many as rows, over the range) that hold
    more than two; without such a bin everything stays.
    """
    stats = found.agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.greatest(F.floor(F.count(F.lit(1)) / 2), F.lit(1)).alias("b"))
    d = found.crossJoin(F.broadcast(stats)).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("b"))
    k = F.least(F.floor((F.col("dist") - F.col("lo")) / F.nullif(F.col("w"), F.lit(0.0))), F.col("b") - 1)
    big = d.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("c"), F.first("lo").alias("lo"), F.first("w").alias("w")).filter("c > 2").withColumn("edge", F.col("lo") + (F.col("k") + 1) * F.col("w"))
    bound = big.agg(F.percentile("edge", F.lit(0.75), F.col("c")).alias("bound"))
    return found.crossJoin(F.broadcast(bound)).filter(F.col("bound").isNull() | (F.col("dist") <= 1.2 * F.col("bound"))).select("q_id", "ts_id", "dist")


def map_to_uniform(df: DataFrame, columns: list[str], n: int, tries: int = 3, more: float = 1.05, seed: int | None = 1) -> DataFrame:
    """n rows of df nearest to evenly spread points (scrambled, unless seed is None); short or long selections are filled or cut by sample()."""
    spark, n_query, chosen = df.sparkSession, int(more * n), None
    for _ in range(tries):
        at = halton.points(F.col("id") + int(seed is None), len(columns), seed)
        points = spark.range(n_query).select((-1 - F.col("id")).alias("ts_id"), *[p.alias(c) for p, c in zip(at, columns)])
        chosen = kept(within_volume(nearest(points, df, columns, 1)).select("ts_id").distinct(), "mapped")
        have = chosen.count()
        if have >= n:
            break
        n_query = int(n_query + (n - have) * more)
    return resized(df, chosen, n)


def resized(df: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    have = chosen.count()
    inside = df.join(chosen, "ts_id", "left_semi")
    if have >= n:
        return sample(inside, n)
    return inside.unionByName(sample(df.join(chosen, "ts_id", "left_anti"), n - have))


class _Near:
    """Nearest neighbours of rows by position in the order of ids: some of each row, and more of those rows that run out of them."""

    def __init__(self, rows: DataFrame, columns: list[str]):
        self.rows, self.columns = rows, columns
        self.ids = np.sort(rows.select("ts_id").toArrow()["ts_id"].to_numpy())
        self.alive = np.ones(len(self.ids), bool)
        self.first = np.zeros(len(self.ids), np.int32)
        self.lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # starts, neighbours, distances
        self.table, self.place = np.zeros(len(self.ids), np.int32), np.zeros(len(self.ids), np.int32)
        self.whole = np.zeros(len(self.ids), bool)
        self.ask(np.arange(len(self.ids)))

    def ask(self, some: np.ndarray) -> None:
        left = int(self.alive.sum())
        k = max(1, min(left - 1, max(8, NEIGHBOURS // len(some))))
        of = lambda x: self.rows.join(self.rows.sparkSession.createDataFrame(pd.DataFrame({"ts_id": self.ids[x]})), "ts_id", "left_semi")
        points = self.rows if left == len(self.ids) else of(self.alive)
        found = nearest(self.rows if len(some) == len(self.ids) else of(some), points, self.columns, k).select("q_id", "rank", "ts_id", "dist").toArrow()
        q, rank = np.searchsorted(self.ids[some], found["q_id"].to_numpy()), found["rank"].to_numpy()
        size = np.bincount(q, minlength=len(some))
        starts = np.concatenate(([0], np.cumsum(size)))
        near, dist = np.empty(len(q), np.int32), np.empty(len(q))
        near[starts[q] + rank - 1] = np.searchsorted(self.ids, found["ts_id"].to_numpy())
        dist[starts[q] + rank - 1] = found["dist"].to_numpy()
        self.table[some], self.place[some], self.first[some] = len(self.lists), np.arange(len(some)), 0
        self.whole[some] = (size < k) | (k >= left - 1)
        self.lists.append((starts, near, dist))
        for old in set(range(len(self.lists))) - set(np.unique(self.table[self.alive]).tolist()):
            self.lists[old] = ()  # nobody's any more

    def of(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        starts, near, dist = self.lists[self.table[x]]
        a, b = starts[self.place[x]], starts[self.place[x] + 1]
        return near[a:b], dist[a:b]

    def nth(self, x: int, second: bool = False) -> tuple[float, int | None]:
        """Distance and neighbour of the nearest (second nearest) that is left; without a neighbour, the distance is one that it has at least."""
        near, dist = self.of(x)
        i = int(self.first[x])
        while i < len(near) and not self.alive[near[i]]:
            i += 1
        self.first[x] = i
        if second:
            i += 1
            while i < len(near) and not self.alive[near[i]]:
                i += 1
        if i < len(near):
            return float(dist[i]), int(near[i])
        return (np.inf if self.whole[x] or not len(near) else float(dist[-1])), None

    def ask_more(self) -> None:
        """More neighbours for rows that have few left."""
        few = [x for x in np.flatnonzero(self.alive & ~self.whole).tolist() if self.alive[(near := self.of(x)[0])].sum() < 2 + len(near) // 8]
        self.ask(np.array(few))


def remove_closest(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """n rows left when, again and again, of the closest pair the row with the nearer second neighbour goes.

    The driver holds the rows' ids and at most NEIGHBOURS of their neighbours at a time (8 a row, if that is more). Where these do not tell which pair or row is next, rows with few left get more.
    """
    size = df.count()
    drop = size - n
    if drop <= 0:
        return df
    known = _Near(kept(df.select("ts_id", *columns), "closest"), columns)
    # a row's distance is never more than that of its pair here; what has grown is put back
    pairs = [(d, x) for x in range(size) for d in [known.nth(x)[0]] if d < np.inf]
    heapq.heapify(pairs)
    while drop:
        if not pairs:
            raise ValueError("too few rows have coordinates")
        at, a = pairs[0]
        if not known.alive[a]:
            heapq.heappop(pairs)
            continue
        d, b = known.nth(a)
        if d > at:
            heapq.heapreplace(pairs, (d, a)) if d < np.inf else heapq.heappop(pairs)
            continue
        if b is None:
            known.ask_more()
            continue
        (da, sa), (db, sb) = known.nth(a, True), known.nth(b, True)
        sure_a, sure_b = sa is not None or da == np.inf, sb is not None or db == np.inf
        if sure_a and da <= db:
            worse = a
        elif sure_b and da > db:
            worse = b
        else:
            known.ask_more()
            continue
        known.alive[worse] = False
        drop -= 1
    gone = df.sparkSession.createDataFrame(pd.DataFrame({"ts_id": known.ids[~known.alive]}))
    return df.join(gone, "ts_id", "left_anti")


def _bins(df: DataFrame, columns: list[str], most: int, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bin numbers of a sample of df, and of the chosen rows that are not in it."""
    rows = sample(df.select("ts_id", *columns), most).toPandas()
    if len(rows) == most:
        own = df.join(F.broadcast(chosen.select("ts_id").distinct()), "ts_id", "left_semi").select("ts_id", *columns).toPandas()
        rows = pd.concat([rows, own[~own["ts_id"].isin(rows["ts_id"])].sort_values("ts_id")])
    return rows["ts_id"].to_numpy(), np.stack([np.searchsorted(EDGES, rows[c].to_numpy(), side="right") for c in columns], axis=1)


def _score(counts: np.ndarray, n: int) -> float:
    b = counts.shape[1]
    return float(np.sqrt(((counts / n - 1 / b) ** 2).sum(axis=1)).mean() / np.sqrt(1 - 1 / b))


def equilize(df: DataFrame, pool: DataFrame, columns: list[str], n_swap: int = 5, tries: int = 20, max_loops: int = 5000, most_failed: int = 10, seed: int = 1, trace: list | None = None) -> DataFrame:
    """df with rows exchanged for rows of pool so that heterogeneity falls: rows of an emptiest cell in, rows of a fullest cell out.

    The score depends on counts by cell alone, so a try is a change of counts. Accepted only if the score falls;
    after most_failed failures fewer rows are exchanged with more tries.
    """
    ids, bins = _bins(pool, columns, POOL, df)
    chosen = {r["ts_id"] for r in df.select("ts_id").collect()}
    rng, n, d, b = np.random.default_rng(seed), len(chosen), len(columns), len(EDGES) + 1
    inside = np.isin(ids, list(chosen))
    count = lambda rows: np.stack([np.bincount(bins[rows, j], minlength=b) for j in range(d)])
    counts, failed = count(inside), 0

    def pick(cells: np.ndarray, weights: np.ndarray, among: np.ndarray, sign: int, now: np.ndarray, size: int) -> np.ndarray | None:
        if weights.sum() <= 0:
            return None
        j, k = divmod(int(cells[rng.choice(len(cells), p=weights / weights.sum())]), b)
        rows = np.flatnonzero(among & (bins[:, j] == k))
        if len(rows) < n_swap:
            return None
        options = [rng.choice(rows, n_swap, replace=False) for _ in range(tries)]
        return min(options, key=lambda r: _score(now + sign * count(r), size))

    for loop in range(max_loops):
        if n_swap < 1:
            break
        before = _score(counts, n)
        flat = counts.ravel() / n
        low, high = np.argsort(flat, kind="stable")[:8], np.argsort(-flat, kind="stable")[:5]
        add = pick(low, flat[low].max() - flat[low] + 1 / b, ~inside, 1, counts, n + n_swap)
        after = before
        if add is not None:
            more = counts + count(add)
            now = inside.copy()
            now[add] = True
            drop = pick(high, np.maximum(flat[high] - 1 / b, 0), now, -1, more, n)
            if drop is not None:
                after = _score(more - count(drop), n)
        if after < before:
            inside = now
            inside[drop] = False
            counts = more - count(drop)
        else:
            failed += 1
            if failed >= most_failed:
                n_swap, tries, failed = n_swap - 1, int(1.5 * tries), 0
        if trace is not None:
            trace.append((loop, failed, n_swap, tries, before, min(before, after)))
    kept = df.sparkSession.createDataFrame([(int(i),) for i in ids[inside]], "ts_id long")
    return pool.join(F.broadcast(kept), "ts_id", "left_semi")


def single(df: DataFrame, columns: list[str], n: int, max_loops: int = 5000) -> DataFrame:
    return equilize(remove_closest(map_to_uniform(df, columns, int(1.2 * n)), columns, n), df, columns, max_loops=max_loops)


def chain(df: DataFrame, columns: list[str], sizes: tuple[int, ...] = (2048, 512, 128, 32), max_loops: int = 5000) -> DataFrame:
    """(ts_id, set_size): nested sets, each chosen from the one before."""
    spark, out, now = df.sparkSession, None, df
    for n in sizes:
        ids = [r["ts_id"] for r in single(now, columns, n, max_loops).select("ts_id").collect()]
        part = spark.createDataFrame([(i,) for i in ids], "ts_id long")
        now = df.join(F.broadcast(part), "ts_id", "left_semi")
        part = part.withColumn("set_size", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def correlation_clusters(df: DataFrame, columns: list[str], threshold: float = 0.4, linkage: str = "average", criterion: str = "distance", method: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(feature, label, pos): clusters over 1 - |r|, cut at 1 - threshold (or into that many, by maxclust), and each feature's place in the order of leaves; the matrix has one row a pair of features."""
    return hierarchical(df, columns, threshold, linkage, criterion, method)[1]


def hierarchical(df: DataFrame, columns: list[str], threshold: float = 0.4, linkage: str = "average", criterion: str = "distance", method: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The matrix (fi, fj, r), computed once, and (feature, label, pos)."""
    matrix = kept(correlation_matrix(df, columns, method), "correlations")
    m = matrix.toPandas().pivot(index="fi", columns="fj", values="r").loc[columns, columns].to_numpy(dtype=float)
    apart = np.maximum(0, 1 - np.nan_to_num(np.abs(m)))  # features without a correlation are as far apart as can be
    found = L.merges(apart, linkage)
    labels = L.flat(found, 1 - threshold if criterion == "distance" else threshold, criterion)
    place = np.argsort(L.order(found, apart))
    rows = [(c, int(k), int(p)) for c, k, p in zip(columns, labels, place)]
    return matrix, df.sparkSession.createDataFrame(rows, "feature string, label int, pos int")
