"""Near-duplicate vectors by cosine, exactly, with cover trees and a dual traversal.

Vectors are scaled to length 1, where cosine >= c is distance <= sqrt(2 - 2c). They are dealt to cells around
PIVOTS (a bounded sample, spread out greedily; it steers the work, not the result) and, within a cell, to blocks of
about BLOCK (twice that at most). A block's vectors form a cover tree: nested levels of centres whose radii halve, each node with the
largest distance to anything below it. A block is one row, its vectors in the order of its tree. Every two blocks
whose covering radii admit a link meet in a Cartesian product, which copies no vectors to disk. The trees of both are
traversed together: pairs of nodes farther apart than their radii and the threshold admit are dropped, and pairs of
leaves are compared by matrix products, in single precision with a margin first and then, where they may link, in double.

A task holds two blocks and the leaves of one at a time against runs of the other's. Of their links it returns, for each
vector, how many and one vector of the same component among the two blocks, so groups of copies never become all pairs.

Defined results: vectors that are null, zero, or hold a null or non-finite component link with nothing and are
their own component; vectors of different lengths do not link; rows that share a vec_id are compared as one vector
each and reported each, and are one node; a vector with a null vec_id links with nothing and has a null component; a vector of any length is
compared whole; no rows give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.llm.common import giving_back, kept
from loadscape.llm.components import components

COSINE, BLOCK, LEAF, PIVOTS, SAMPLE = 0.9, 8192, 256, 64, 4096
#: Blocks are smaller where vectors are few, so that there are some to share out, or long; rows of a leaf compared at once.
_LEAST, _SHARES, _SLICE, _BYTES = 1024, 16, 256, 1 << 23
_SLACK = 1e-7
NODE = np.dtype([("center", "i4"), ("first", "i4"), ("last", "i4"), ("kid", "i4"), ("kids", "i4"), ("radius", "f8")])
_BLOCK_ROW = "b long, center array<double>, radius double, ids binary, x binary, nodes binary"


def _distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ center)))


class CoverTree:
    """Levels of nodes over rows of unit vectors; a node's members are a slice of x, its children are nodes that follow each other."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, nodes: np.ndarray):
        self.x, self.ids, self.nodes = x, ids, nodes
        self.centers, self.single = x[nodes["center"]], x.astype(np.float32)

    @classmethod
    def grown(cls, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> CoverTree:
        order, nodes, levels = np.arange(len(x)), [], []
        # the root is the vector nearest to the mean
        first = int((x @ x.mean(axis=0)).argmax())
        order[[0, first]] = order[[first, 0]]

        def add(first: int, last: int, level: float) -> None:
            rows = order[first:last]
            nodes.append((rows[0], first, last, 0, 0, float(_distances(x[rows], x[rows[0]]).max())))
            levels.append(level)

        add(0, len(x), 2.0)
        for me, (_, first, last, _, _, radius) in enumerate(nodes):
            if last - first <= leaf or radius <= 2 * _SLACK:
                continue
            which, level = cls._next(x[order[first:last]], radius, levels[me], leaf)
            by = np.argsort(which, kind="stable")
            order[first:last] = order[first:last][by]
            ends = first + np.cumsum(np.bincount(which))
            if len(ends) > 1:
                nodes[me] = (*nodes[me][:3], len(nodes), len(ends), radius)
                for a, b in zip((first, *ends[:-1].tolist()), ends.tolist()):
                    add(a, b, level)
        place = np.empty(len(x), int)
        place[order] = np.arange(len(x))
        found = np.array(nodes, NODE)
        found["center"] = place[found["center"]]
        return cls(x[order], ids[order], found)

    @staticmethod
    def _next(x: np.ndarray, radius: float, level: float, leaf: int) -> tuple[np.ndarray, float]:
        """Of each member, which of the next level's centres is nearest: centres at least that level's radius apart, the node's own first; all 0 if everything is close to it."""
        far, most = _distances(x, x[0]), max(2, min(64, 2 * len(x) // leaf))
        while level > 0.01:
            level /= 2
            if level > radius:
                continue
            nearest, which, centers = far.copy(), np.zeros(len(x), int), 1
            while centers < most and nearest[at := int(nearest.argmax())] > level:
                d = _distances(x, x[at])
                closer = d < nearest
                nearest[closer], which[closer] = d[closer], centers
                centers += 1
            if centers > 1:
                # a centre equal to another has no members of its own
                return np.unique(which, return_inverse=True)[1], level
        return np.zeros(len(x), int), level

    def row(self, b: int) -> tuple:
        return b, self.centers[0].tolist(), float(self.nodes["radius"][0]), self.ids.tobytes(), self.x.tobytes(), self.nodes.tobytes()

    @classmethod
    def read(cls, ids: memoryview, x: memoryview, nodes: memoryview) -> CoverTree:
        of = np.frombuffer(ids, np.int64)
        return cls(np.frombuffer(x, np.float64).reshape(len(of), -1), of, np.frombuffer(nodes, NODE))


def dual(a: CoverTree, b: CoverTree, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may hold vectors within limit of each other."""
    near = np.sqrt(np.maximum(0, 2 - 2 * (a.centers @ b.centers.T))) <= limit + a.nodes["radius"][:, None] + b.nodes["radius"] + _SLACK
    i, j, found = np.zeros(1, int), np.zeros(1, int), []
    while len(i):
        i, j = (x[near[i, j]] for x in (i, j))
        whole_a, whole_b = a.nodes["kids"][i] == 0, b.nodes["kids"][j] == 0
        found.append((i[whole_a & whole_b], j[whole_a & whole_b]))
        down = ~whole_b & (whole_a | (b.nodes["radius"][j] >= a.nodes["radius"][i]))
        up = ~whole_a & ~down
        i, j = (np.concatenate(x) for x in zip(_below(j, i, down, b.nodes)[::-1], _below(i, j, up, a.nodes)))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _below(i: np.ndarray, j: np.ndarray, some: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes i, each with j, of some pairs."""
    i, j = i[some], j[some]
    n = nodes["kids"][i]
    return np.repeat(nodes["kid"][i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(j, n)


def linked(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b that link, pair by pair; within one tree (b is a) each pair once."""
    p, q = dual(a, b, float(np.sqrt(max(0.0, 2 - 2 * cosine))))
    order = np.lexsort((b.nodes["first"][q], a.nodes["first"][p]))
    p, q = p[order], q[order]
    if a is b:
        p, q = (x[a.nodes["first"][p] <= a.nodes["first"][q]] for x in (p, q))
    first, last = b.nodes["first"][q], b.nodes["last"][q]
    # leaves of b that follow each other are one run
    starts = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (first[1:] != last[:-1])))) if len(p) else []
    margin = (a.x.shape[1] + 4) * 1.2e-7
    for s, e in zip(starts, (*starts[1:], len(p))):
        lo, hi, top = int(first[s]), int(last[e - 1]), int(a.nodes["last"][p[s]])
        for at in range(int(a.nodes["first"][p[s]]), top, _SLICE):
            end = min(at + _SLICE, top)
            close = (a.single[at:end] @ b.single[lo:hi].T).ravel()
            i, j = np.divmod(np.flatnonzero(close >= cosine - margin), hi - lo)
            if not len(i):
                continue
            if a is b:
                once = at + i < lo + j
                i, j = i[once], j[once]
            if 32 * len(i) > close.size:
                exact = (a.x[at:end] @ b.x[lo:hi].T)[i, j]
            else:
                exact = np.einsum("ij,ij->i", a.x[at + i], b.x[lo + j])
            i, j = at + i[exact >= cosine], lo + j[exact >= cosine]
            other = a.ids[i] != b.ids[j]
            if other.any():
                yield i[other], j[other]


class Local:
    """Components among the vectors of two blocks."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := self.parent[i], i):
            i = up
        return i

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.roots(i), self.roots(j)
        apart = i != j
        for x in np.unique(i[apart] * len(self.parent) + j[apart]).tolist():
            a, b = map(self.root, divmod(x, len(self.parent)))
            self.parent[max(a, b)] = min(a, b)


def links_of(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors with any link between a and b: id, how many, and the id of one vector of their component."""
    ids = a.ids if a is b else np.concatenate((a.ids, b.ids))
    n, local, shift = np.zeros(len(ids), np.int64), Local(len(ids)), 0 if a is b else len(a.ids)
    for i, j in linked(a, b, cosine):
        n += np.bincount(i, minlength=len(ids)) + np.bincount(j + shift, minlength=len(ids))
        local.join(i, j + shift)
    some = np.flatnonzero(n)
    return ids[some], n[some], ids[local.roots(some)]


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """id and u (unit vector) of those rows of id and v that can link; rows may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["v"]
            x = np.append(v.flatten().to_numpy(zero_copy_only=False), 0.0)  # a null component is nan
            size = np.diff(v.offsets.to_numpy())
            first = np.cumsum(size) - size
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            size = np.where(bad[first + size] == bad[first], size, 0)
            for dims in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == dims)
                u = x[first[rows, None] + np.arange(dims)]
                # scaled by the largest component first, so that no square overflows or vanishes
                top = np.abs(u).max(axis=1)
                rows, u = rows[top > 0], u[top > 0] / top[top > 0, None]
                u /= np.sqrt((u * u).sum(axis=1))[:, None]
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * np.int32(dims)), pa.array(u.ravel()))], names=["id", "u"])

    return vectors.filter("id is not null and v is not null").mapInArrow(run, "id long, u array<double>")


def pivots(x: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Greedily spread centres among unit vectors."""
    chosen, nearest = [0], 2 - 2 * (x @ x[0])
    while len(chosen) < min(n, len(x)) and nearest.max() > 0.2:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, 2 - 2 * (x @ x[chosen[-1]]))
    return x[chosen]


def blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a block of the vectors (id, v) that can link: a number, its tree's root and radius, and its tree."""
    units, count = unit_vectors(vectors), vectors.count()
    # a bounded sample, of the smallest hashes, steers the work
    some = unit_vectors(vectors.orderBy(F.xxhash64("id", "v")).limit(SAMPLE)).toPandas()["u"]
    dims = int(some.map(len).mode()[0]) if len(some) else 0
    x = np.stack([u for u in some if len(u) == dims]) if dims else np.zeros((1, 0))
    size = max(1, min(block, max(_LEAST, count // _SHARES), _BYTES // (8 * max(1, dims))))
    centers = pivots(x, max(1, min(PIVOTS, count // size)))
    # the share of each cell, and of vectors of other lengths
    shares = np.append(np.bincount((x @ centers.T).argmax(axis=1), minlength=len(centers)), len(some) - len(x)) / max(1, len(some))
    shared = units.sparkSession.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for part in batches:
            cell = np.full(len(part), len(c), np.int32)
            fits = np.flatnonzero(part["u"].map(len).to_numpy() == c.shape[1]) if len(part) else []
            for at in range(0, len(fits), 4096):
                rows = fits[at : at + 4096]
                cell[rows] = (np.stack(part["u"].to_numpy()[rows]) @ c.T).argmax(axis=1)
            yield part.assign(cell=cell)

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found, out, home = part["u"].map(len).to_numpy(), [], (int(key[0]) << 20 | int(key[1])) << 20
        for dims in np.unique(found):
            some = part[found == dims]
            ids, x = some["id"].to_numpy(np.int64), np.stack(some["u"].to_numpy())
            # rows that repeat an id's vector are one
            keys = np.column_stack((ids.view(np.uint64), x.view(np.uint64)))
            keep = np.sort(np.unique(np.ascontiguousarray(keys).view([("", keys.dtype)] * keys.shape[1]).ravel(), return_index=True)[1])
            for rows in np.array_split(keep, -(-len(keep) // max(1, 2 * size))):
                out.append(CoverTree.grown(x[rows], ids[rows]).row(home + len(out)))
        return pd.DataFrame(out, columns=["b", "center", "radius", "ids", "x", "nodes"])

    in_cell = F.element_at(F.array(*[F.lit(max(1, round(float(s) * count / size))) for s in shares]), F.col("cell") + 1)
    dealt = units.mapInPandas(assign, "id long, u array<double>, cell int").withColumn("part", F.pmod(F.xxhash64("id", "u"), in_cell).cast("int"))
    return kept(dealt.groupBy("cell", "part").applyInPandas(build, _BLOCK_ROW), "vector-blocks")


def links(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """id, n (links found between two blocks) and near (an id of the component that these links make), of vectors (id, v)."""
    found = blocks(vectors, block)
    n = max(1, found.count())
    # partitions meet each other: of one or two blocks each, so that a batch has few pairs; without a key, and so of even size
    dealt = found.repartition(min(n, _SHARES + n // 2))
    a, b = (dealt.select(*[F.col(c).alias(f"{c}_{side}") for c in found.columns]) for side in "ab")
    # centres of different lengths give null, and no pair
    product = F.aggregate(F.zip_with("center_a", "center_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    gap = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * product))
    limit = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
    near = a.hint("shuffle_replicate_nl").join(b, (F.col("b_a") <= F.col("b_b")) & (gap <= F.col("radius_a") + F.col("radius_b") + limit))
    columns = ["ids_a", "x_a", "nodes_a", "ids_b", "x_b", "nodes_b"]

    @giving_back
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ours, theirs = ([batch[c][k].as_buffer() for c in side] for side in (columns[:3], columns[3:]))
                one = CoverTree.read(*ours)
                same = batch["same"][k].as_py()
                ids, n, to = links_of(one, one if same else CoverTree.read(*theirs), cosine)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(to)], names=["id", "n", "near"])

    return near.select(*columns, (F.col("b_a") == F.col("b_b")).alias("same")).mapInArrow(compare, "id long, n long, near long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    found = kept(links(rows, cosine, block), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    labels = components(found.select(F.col("id").alias("u"), F.col("near").alias("v")))
    me = F.col("vec_id")
    return (
        vectors.select(F.col(id_col).alias("vec_id"))
        .join(counts.withColumnRenamed("id", "c_id"), me == F.col("c_id"), "left")
        .join(labels.withColumnRenamed("id", "l_id"), me == F.col("l_id"), "left")
        .withColumn("component_id", F.coalesce("component", me.cast("long")))
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (me == F.col("component_id")).alias("kept"))
    )
