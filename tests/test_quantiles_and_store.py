"""Exact percentiles against numpy, and stages that are made once."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscape.operators import quantiles as Q
from loadscape.operators import space as S
from loadscape.sources.store import Store

P = (0.0, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0)


def shapes(n=900):
    rng = random.Random(4)
    return {
        "even": [rng.random() for _ in range(n)],
        "skewed": [10.0 ** rng.uniform(-300, 300) * rng.choice((-1, 1)) for _ in range(n)],
        "ties": [float(rng.choice((1, 1, 1, 2, 7))) for _ in range(n)],
        "one": [3.5] * n,
        "ends": [rng.choice((-1.7e308, 1.7e308, 0.0, 5e-324)) for _ in range(n)],
        "single": [2.0],
        "two": [1.0, 4.0],
        None: [float(i) for i in range(n)],
        "endless": [math.inf] * 300 + [-math.inf] * 100 + [rng.gauss(0, 1) for _ in range(n)],
    }


@pytest.mark.parametrize(("most", "cuts", "accuracy"), [(1 << 16, 64, 10_000), (20, 8, 50)])
def test_percentiles_of_groups(spark, most, cuts, accuracy):
    rows = [(g, v) for g, values in shapes().items() for v in values] + [("even", None), ("even", math.nan), ("none", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in Q.exact(df, ["g"], P, most=most, cuts=cuts, accuracy=accuracy).collect()}
    assert got.keys() == shapes().keys()
    for g, values in shapes().items():
        assert got[g]["n"] == len(values)
        ordered = sorted(values)
        for p, x in zip(P, got[g]["q"]):
            at = p * (len(values) - 1)
            a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert x == a == b or a <= x <= b and (math.isinf(a) or math.isinf(b) or math.isclose(x, (math.ceil(at) - at) * a + (at - math.floor(at)) * b, rel_tol=1e-12))


def test_no_rows_no_percentiles(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert Q.exact(df, ["g"], P).count() == 0
    assert Q.of_columns(spark.createDataFrame([(None, 1.0)], "a double, b double"), ["a", "b"], (0.5,)) == {"a": [None], "b": [1.0]}


def test_space_with_empty_and_constant_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), 5.0, None) for i, x in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "ts_id long, a double, b double, c double")
    got = S.normalised(df, ["a", "b", "c"]).orderBy("ts_id").toPandas()
    a = np.array([r[1] for r in rows])
    q = np.percentile(a, [25, 50, 75])
    s = 1 / (1 + np.exp(-(a - q[1]) / (1.35 * (q[2] - q[0]) + 1e-12)))
    w = np.percentile(s, [25, 75])
    lo, hi = s[s >= w[0] - 1.5 * (w[1] - w[0])].min(), s[s <= w[1] + 1.5 * (w[1] - w[0])].max()
    s = np.clip(s, lo, hi)
    assert np.allclose(got["a"], (s - s.min()) / (s.max() - s.min())) and got["b"].isna().all() and got["c"].isna().all()


def test_no_task_holds_a_column(spark):
    """The plan of the result has no percentile aggregate and no single partition."""
    df = spark.range(1000).select(F.rand(3).alias("v"), F.lit("x").alias("g"))
    plan = Q.exact(df, ["g"], (0.5,), most=10)._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "SinglePartition" not in plan


def test_stages_are_made_once(spark, tmp_path):
    calls = []
    spark.range(10).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.read.parquet(f"{tmp_path}/in")

    def double(df, by=2):
        calls.append(("double", by))
        return df.select((F.col("id") * by).alias("id"))

    def total(df):
        calls.append(("total",))
        return df.agg(F.sum("id").alias("n"))

    def run(by=2):
        store = Store(spark, f"{tmp_path}/stages")
        made = store.stage("double", double, source(), by=by)
        return store, store.stage("total", total, made).first()["n"]

    store, n = run()
    assert n == 90 and (store.made, store.reused) == (2, 0)
    store, n = run()
    assert n == 90 and (store.made, store.reused) == (0, 2) and len(calls) == 2
    assert run(by=3)[1] == 135 and len(calls) == 4
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/in")
    store, n = run()
    assert n == 110 and (store.made, store.reused) == (2, 0)


def test_a_broken_attempt_is_not_read(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"{tmp_path}/stages")
    made = store.stage("copy", lambda df: df, spark.read.parquet(f"{tmp_path}/in"))
    path = made.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    (tmp_path / "x").mkdir()
    import os

    os.makedirs(f"{path}/000-broken")
    with open(f"{path}/000-broken/part-0.parquet", "w") as file:
        file.write("not whole")
    again = Store(spark, f"{tmp_path}/stages")
    assert again.stage("copy", lambda df: df, spark.read.parquet(f"{tmp_path}/in")).count() == 3 and again.reused == 1
    with pytest.raises(RuntimeError):
        Store(spark, f"{tmp_path}/stages").stage("fails", _fails, spark.read.parquet(f"{tmp_path}/in"))
    assert Store(spark, f"{tmp_path}/stages").stage("fails", lambda df: df.filter("id > 0"), spark.read.parquet(f"{tmp_path}/in")).count() == 2


def test_wide_plans_are_told_apart(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"{tmp_path}/stages")
    wide = lambda last: spark.read.parquet(f"{tmp_path}/in").select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)], (F.col("id") * last).alias("last"))
    sums = [store.stage("wide", lambda df: df.agg(F.sum("last").alias("n")), wide(k)).first()["n"] for k in (2, 3, 2)]
    assert sums == [6, 9, 6] and (store.made, store.reused) == (2, 1)


def _fails(df):
    raise RuntimeError("no")
