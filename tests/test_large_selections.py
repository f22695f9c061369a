"""Selections over more rows than one block or one sample holds."""

import random

from loadscape.operators import decluster, space


def rows(spark, n):
    rng = random.Random(4)
    return spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(n)], "ts_id long, a double, b double")


def test_nearest_has_no_most_queries(spark, monkeypatch):
    df = rows(spark, 60)
    whole = sorted(map(tuple, space.nearest(df, df, ["a", "b"], 3).collect()))
    monkeypatch.setattr(space, "QUERIES", 7)
    assert len(whole) == 180 and sorted(map(tuple, space.nearest(df, df, ["a", "b"], 3).collect())) == whole
    monkeypatch.undo()
    many = spark.range(20_001).selectExpr("id AS ts_id", "id / 20001 AS a")
    assert space.nearest(many, many.filter("ts_id < 2"), ["a"], 1).count() == 20_001


def test_chosen_rows_outside_the_sample_stay(spark, monkeypatch):
    pool = rows(spark, 200).cache()
    chosen = pool.filter("ts_id % 5 = 0")
    whole = decluster.equilize(chosen, pool, ["a", "b"], n_swap=2, max_loops=30).count()
    monkeypatch.setattr(decluster, "POOL", 50)
    kept = decluster.equilize(chosen, pool, ["a", "b"], n_swap=2, max_loops=30)
    assert whole == kept.count() == 40
    assert {r["ts_id"] for r in decluster.equilize(chosen, pool, ["a", "b"], max_loops=0).collect()} == {r["ts_id"] for r in chosen.collect()}
