"""Hierarchical clusters of a matrix of dissimilarities between features, of which there are few: merges, flat clusters, and the order of leaves."""

from __future__ import annotations

import numpy as np

#: Lance-Williams coefficients of the two parts, of their distance and of the difference, by the sizes of the parts and of the third.
METHODS = {
    "single": lambda a, b, c: (0.5, 0.5, 0.0, -0.5),
    "complete": lambda a, b, c: (0.5, 0.5, 0.0, 0.5),
    "average": lambda a, b, c: (a / (a + b), b / (a + b), 0.0, 0.0),
    "weighted": lambda a, b, c: (0.5, 0.5, 0.0, 0.0),
    "ward": lambda a, b, c: ((a + c) / (a + b + c), (b + c) / (a + b + c), -c / (a + b + c), 0.0),
}


def merges(dissimilarity: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """(part, part, height, size) of each merge; leaves count from 0, and the k-th merge is part n + k. Of pairs as close, the one with the smallest leaves goes first."""
    if method not in METHODS:
        raise ValueError(f"{', '.join(METHODS)}, not {method!r}")
    n = len(dissimilarity)
    squares = method == "ward"
    d = dissimilarity.astype(float) ** (2 if squares else 1)
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(n), list(range(n)), []
    for k in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        height = d[i, j]
        live = np.isfinite(d[i]) & np.isfinite(d[j])
        p, q, r, s = METHODS[method](size[i], size[j], size)
        with np.errstate(invalid="ignore"):
            new = np.where(live, p * d[i] + q * d[j] + r * height + s * np.abs(d[i] - d[j]), np.inf)
        out.append((name[i], name[j], float(np.sqrt(height) if squares else height), int(size[i] + size[j])))
        d[i], d[:, i] = new, new
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i], name[i] = size[i] + size[j], n + k
    return out


def flat(found: list[tuple[int, int, float, int]], limit: float, criterion: str = "distance") -> np.ndarray:
    """Labels from 1, in the order of each cluster's first leaf: merges up to a height (distance), or until so many clusters are left (maxclust)."""
    if criterion not in ("distance", "maxclust"):
        raise ValueError(f"distance or maxclust, not {criterion!r}")
    n = len(found) + 1
    members = {i: [i] for i in range(n)}
    for k, (a, b, height, _) in enumerate(found):
        if height > limit if criterion == "distance" else len(members) <= limit:
            break
        members[n + k] = members.pop(a) + members.pop(b)
    label = np.zeros(n, int)
    for i, rows in enumerate(sorted(members.values(), key=min), 1):
        label[rows] = i
    return label


def order(found: list[tuple[int, int, float, int]], dissimilarity: np.ndarray) -> list[int]:
    """The order of leaves that keeps every merge together and has the smallest sum of dissimilarities between neighbours.

    For each part and each pair of leaves at its ends, the best sum follows from those of its two parts.
    """
    n = len(found) + 1
    d = dissimilarity.astype(float)
    leaves: dict[int, np.ndarray] = {i: np.array([i]) for i in range(n)}
    best: dict[int, np.ndarray] = {i: np.zeros((1, 1)) for i in range(n)}  # by first and last leaf, as places in leaves
    for k, (a, b, *_) in enumerate(found):
        x, y = leaves[a], leaves[b]
        step = np.min(best[a][:, :, None] + d[x][:, y][None], axis=1) if len(x) > 1 else d[x][:, y]  # first leaf of a, first of b behind it
        across = np.min(step[:, :, None] + best[b][None], axis=1)
        m = np.full((len(x) + len(y),) * 2, np.inf)
        m[: len(x), len(x) :] = across
        m[len(x) :, : len(x)] = across.T
        leaves[n + k], best[n + k] = np.concatenate((x, y)), m

    def walk(part: int, first: int, last: int) -> list[int]:
        """The leaves of a part from one to another."""
        if part < n:
            return [part]
        a, b, *_ = found[part - n]
        if first not in leaves[a]:
            return walk(part, last, first)[::-1]
        x, y = leaves[a], leaves[b]
        i, j = int(np.flatnonzero(x == first)[0]), int(np.flatnonzero(y == last)[0])
        sums = best[a][i][:, None] + d[x][:, y] + best[b][:, j][None]
        p, q = divmod(int(sums.argmin()), len(y))
        return walk(a, first, int(x[p])) + walk(b, int(y[q]), last)

    if n == 1:
        return [0]
    top = n + len(found) - 1
    i, j = divmod(int(best[top].argmin()), n)
    return walk(top, int(leaves[top][i]), int(leaves[top][j]))
