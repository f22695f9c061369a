"""Exact top-k by inner product without random access to the lists.

Components become integers, floor(64 x). In each block of candidates every dimension is a list sorted by value; a
query reads the lists of its positive components from the top and those of its negative ones from the bottom, all
to the same depth, chunk after chunk, and adds what it reads to the candidates' known sums. An unread entry lies
between the list's far end and the value at the depth reached, which bounds every candidate's score from below and
above. A query stops once few candidates (4 k or a sixteenth of the block) outside its k best lower bounds have an upper bound that
reaches them; the scores of those that may still qualify, and of no others, are then resolved in integers. A query
that does not stop has read its lists to the end, and its known sums are the scores. All queries of a block read a chunk
together, as a matrix product over the chunk's entries.

Queries and candidates meet in blocks: about QUERY_BLOCK rows of one against BLOCK of the other, at most k rows a query out of
each pair of blocks, then the best k over all blocks. Every task's input is bounded by those, whatever the tables.

Defined results: a vector that is null or holds a null or non-finite component takes no part; shorter vectors count
as ended with zeros; every row is a query or a candidate of its own, also where rows share a vec_id or repeat, and
only the query's own row is not ranked; ties go to the smaller vec_id; a null vec_id takes no part; a component or
a score outside the range of a long counts as the nearest end of it; no rows give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadscape.llm.common import kept

K, SCALE, BLOCK, QUERY_BLOCK = 20, 64, 8192, 2048
#: Depths at which bounds are looked at, as shares of the lists.
STEPS = (0.25, 0.5, 0.75, 1.0)
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row, vec_id and q (array<long>) of the vectors that take part."""
    v = F.col(vector_col)
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    q = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), x.cast("double") * SCALE))))
    return vectors.filter(finite & F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), q.alias("q"))


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    if all(len(r) == dims for r in rows):
        return np.array(rows.tolist(), np.int64).reshape(len(rows), dims)
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(query: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Integer inner products of a query with some vectors."""
    top = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if top(query) * top(some) * max(1, len(query)) <= _LONG:
        return some @ query
    exact = (some.astype(object) * query.astype(object)).sum(axis=1)
    return np.array([max(-_LONG - 1, min(_LONG, int(x))) for x in exact], np.int64)


def block_topk(query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K, steps: tuple[float, ...] = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, candidate positions and scores of each query's k best in this block, and the share of the lists that each query read."""
    n, dims = vectors.shape
    x, v = queries.astype(float), vectors.astype(float)
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    by = np.argsort(vectors, axis=0, kind="stable")
    ordered = np.take_along_axis(v, by, 0)
    place = np.empty((n, dims), np.int64)
    np.put_along_axis(place, by, np.arange(n)[:, None], 0)
    low_end, high_end = ordered[0], ordered[-1]
    slack = np.abs(x) @ np.abs(v).max(axis=0) * 2.0**-46  # more than the rounding of a sum
    own = np.full(len(queries), -1)
    at_row = {r: i for i, r in enumerate(rows.tolist())}
    for i, r in enumerate(query_rows.tolist()):
        own[i] = at_row.get(r, -1)
    known, alive, done, read = np.zeros((len(queries), n)), np.arange(len(queries)), 0, np.ones(len(queries))
    found: tuple[list, list, list] = ([], [], [])
    for step in steps:
        upto = n if step >= 1 else max(done, min(n, int(np.ceil(step * n))))
        # the entries from depth `done` to `upto` of every list
        known += up[alive] @ np.where((place >= n - upto) & (place < n - done), v, 0.0).T + down[alive] @ np.where((place < upto) & (place >= done), v, 0.0).T
        done = upto
        if done < n:
            above, below = (place < n - done).astype(float), (place >= done).astype(float)  # unread, from either end
            upper = known + (up[alive] * ordered[n - done]) @ above.T + (down[alive] * ordered[done - 1]) @ below.T
            lower = known + (up[alive] * low_end) @ above.T + (down[alive] * high_end) @ below.T
        else:
            upper, lower = known.copy(), known.copy()
        mine = np.flatnonzero(own[alive] >= 0)
        for bound in (upper, lower):
            np.clip(bound, -float(_LONG), float(_LONG), out=bound)
            bound[mine, own[alive][mine]] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(alive), -np.inf)
        may = (upper >= (bar - 2 * slack[alive])[:, None]) & (upper > -np.inf)
        stop = np.full(len(alive), True) if done == n else may.sum(axis=1) <= max(4 * k, n // 16)
        for i in np.flatnonzero(stop).tolist():
            c = np.flatnonzero(may[i])
            scores = _products(queries[alive[i]], vectors[c])
            best = np.lexsort((ids[c], ~scores))[:k]  # ~x falls as x rises, and fits
            found[0].append(np.full(len(best), alive[i]))
            found[1].append(c[best])
            found[2].append(scores[best])
            read[alive[i]] = done / n
        known, alive = known[~stop], alive[~stop]
        if not len(alive):
            break
    return *(np.concatenate([np.zeros(0, np.int64), *f]) for f in found), read


def topk(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have row, vec_id and q (array<long>), and equal rows are the same one."""
    n_q, n_c = (max(1, -(-x.count() * 5 // (4 * most))) for x, most in ((queries, query_block), (candidates, block)))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda n, salt: F.pmod(F.xxhash64(F.col("row"), F.lit(salt)), F.lit(n)).cast("int")
    left = queries.select("row", "vec_id", "q", spread(n_q, "q").alias("qb"), blocks(n_c).alias("cb"))
    right = candidates.select("row", "vec_id", "q", spread(n_c, "c").alias("cb"), blocks(n_q).alias("qb"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
        dims = int(max(a["q"].map(len).max(), b["q"].map(len).max()))
        ids = b["vec_id"].to_numpy()
        q, c, s, _ = block_topk(a["row"].to_numpy(), _matrix(a["q"], dims), b["row"].to_numpy(), ids, _matrix(b["q"], dims), k)
        return pd.DataFrame({"query_row": a["row"].to_numpy()[q], "query_id": a["vec_id"].to_numpy()[q], "vec_id": ids[c], "score": s})

    near = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(best, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc()))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by `every`; candidates: all rows but the query's own."""
    rows = kept(quantised(vectors), "topk-rows")
    return topk(rows.filter(F.col("vec_id") % every == 0), rows, k)
