"""Removal of the closest rows, against a plain loop over all distances, with whole lists of neighbours and with short ones."""

import random

import pytest

from loadscape.operators import decluster


def plain(rows, n):
    left = dict(rows)
    near = {i: sorted((sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5, j) for j, q in rows if j != i) for i, p in rows}
    near = {i: [(round(d, 6), j) for d, j in x] for i, x in near.items()}
    while len(left) > n:
        near = {i: [x for x in near[i] if x[1] in left] for i in left}
        a = min(left, key=lambda i: (near[i][0][0], i))
        b = near[a][0][1]
        second = lambda i: near[i][1][0] if len(near[i]) > 1 else float("inf")
        left.pop(a if second(a) <= second(b) else b)
    return sorted(left)


@pytest.mark.parametrize("most", (decluster.NEIGHBOURS, 1))
def test_the_same_rows_stay_with_short_lists(spark, monkeypatch, most):
    rng = random.Random(8)
    # spread rows, a dense group, and rows at one place
    rows = [(7 * i, (rng.random(), rng.random())) for i in range(60)] + [(7 * i + 1, (0.5 + rng.random() / 1000, 0.5)) for i in range(30)] + [(7 * i + 2, (0.25, 0.75)) for i in range(12)]
    df = spark.createDataFrame([(i, *p, "x") for i, p in rows], "ts_id long, a double, b double, other string").repartition(3)
    monkeypatch.setattr(decluster, "NEIGHBOURS", most)
    left = decluster.remove_closest(df, ["a", "b"], 8)
    assert left.columns == df.columns and sorted(r["ts_id"] for r in left.collect()) == plain(rows, 8)


def test_the_driver_gets_few_neighbours_and_any_number_of_rows(spark, monkeypatch):
    asked = []
    real = decluster.nearest
    monkeypatch.setattr(decluster, "nearest", lambda q, p, c, k: asked.append(q.count() * k) or real(q, p, c, k))
    df = spark.range(20_500).selectExpr("id AS ts_id", "id * id / 1e3 AS a")
    monkeypatch.setattr(decluster, "NEIGHBOURS", 1 << 16)
    assert decluster.remove_closest(df, ["a"], 18_000).count() == 18_000
    assert len(asked) > 1 and max(asked) <= 8 * 20_500
