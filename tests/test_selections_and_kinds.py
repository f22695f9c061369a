"""Variants and sections of selections, own ways to an initial series, and tables partitioned by kind."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscape.functions import arrays as A
from loadscape.functions import kernels as K
from loadscape.operators import recombine as R
from loadscape.operators import sets as T
from loadscape.sources import series as src
from loadscape.sources.store import Store


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(f"r{k}", [math.sin(i / 7 + k) + i / 90 for i in range(300 + 50 * k)]) for k in range(3)]
    return spark.createDataFrame(rows, "name string, values array<double>")


@pytest.fixture(scope="module")
def selections(spark):
    return spark.createDataFrame([("r0", 10, 110), ("r1", 0, 350), ("r2", 390, 400)], "name string, start int, stop int")


def test_variants_of_selections(spark, raw, selections):
    lengths = raw.select("name", F.size("values").alias("n"))
    got = [tuple(r) for r in R.vary_selections(selections, lengths, 40, seed=5).collect()]
    whole = {r["name"]: r["n"] for r in lengths.collect()}
    assert len(got) == 120
    for name, start, stop in [tuple(r) for r in selections.collect()]:
        own = [(a, b) for n, a, b in got if n == name]
        assert (start, stop) in own and len(set(own)) > 5
        assert all(0 <= a < b <= whole[name] and b - a <= 1.3 * (stop - start) for a, b in own)
        assert all(b - a >= int(0.7 * (stop - start)) or b == whole[name] for a, b in own)
    assert sorted(got) == sorted(tuple(r) for r in R.vary_selections(selections.repartition(3), lengths, 40, seed=5).collect())
    assert sorted(got) != sorted(tuple(r) for r in R.vary_selections(selections, lengths, 40, seed=6).collect())


def test_own_way_to_initial_series(raw, selections):
    plain = R.cut_selections(raw, selections, 50)
    own = R.cut_selections(raw, selections, 50, change=lambda v: A.norm_minmax(v))
    for r in own.collect():
        assert min(r["values"]) == 0 and max(r["values"]) == 1
    assert all(abs(sum(r["values"])) < 1e-9 for r in plain.collect())


def test_sections_lie_over_the_raw_series(raw, selections):
    values = {r["name"]: np.array(r["values"]) for r in raw.collect()}
    for endpoint in (False, True):
        got = R.sections(raw, selections.filter("stop < 350"), 25, endpoint).toPandas()
        for (name, start, stop), rows in got.groupby(["name", "start", "stop"]):
            rows = rows.sort_values("t")
            assert np.allclose(rows["t"], np.linspace(start, stop, 25)) and np.allclose(rows["v"], K.resample(values[name][start:stop], 25))
            assert stop == 110 + endpoint


def test_tables_by_kind(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("ts_id"), F.when(F.col("id") < 6, "only_neg").otherwise("only_posneg").alias("kind")).write.partitionBy("kind").parquet(f"{tmp_path}/pool")
    got = src.by_kind(spark, f"{tmp_path}/pool", R.KINDS)
    assert {k: df.count() for k, df in got.items()} == {"only_neg": 6, "only_posneg": 4} and got["only_neg"].columns == ["ts_id"]
    plan = got["only_neg"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
    spark.range(3).write.parquet(f"{tmp_path}/a")
    both = src.by_kind(spark, {"only_neg": f"{tmp_path}/a", "only_posneg": spark.range(5)}, R.KINDS)
    assert [both[k].count() for k in R.KINDS] == [3, 5]
    with pytest.raises(ValueError):
        src.by_kind(spark, f"{tmp_path}/a", R.KINDS)
    with pytest.raises(KeyError):
        src.by_kind(spark, {"only_neg": f"{tmp_path}/a"}, R.KINDS)


def test_space_of_both_kinds_by_stages(spark, tmp_path):
    rng = np.random.default_rng(3)
    names = [*T.REPRESENTATIVES, *T.EXCLUDED]
    for k in R.KINDS:
        rows = [(i, *map(float, rng.random(len(names)))) for i in range(90)]
        spark.createDataFrame(rows, "ts_id long, " + ", ".join(f"{c} double" for c in names)).write.parquet(f"{tmp_path}/{k}")
    features = lambda: {k: spark.read.parquet(f"{tmp_path}/{k}") for k in R.KINDS}
    first = Store(spark, f"{tmp_path}/stages")
    got = T.staged_space(first, features(), names).toPandas()
    assert (first.made, first.reused) == (3, 0) and set(got["kind"]) == set(R.KINDS) and (got["ts_id"] >= 1_000_000).sum() == (got["kind"] == R.KINDS[1]).sum()
    for _, own in got.groupby("kind"):
        assert all(own[c].min() == 0 and own[c].max() == 1 for c in T.REPRESENTATIVES)
    again = Store(spark, f"{tmp_path}/stages")
    assert T.staged_space(again, features(), names).count() == len(got) and (again.made, again.reused) == (0, 3)
    sets = spark.createDataFrame([(8, r.kind, r.ts_id) for r in got.groupby("kind").head(4).itertuples()] + [(4, r.kind, r.ts_id) for r in got.groupby("kind").head(2).itertuples()], "set_size int, kind string, ts_id long")
    space = spark.createDataFrame(got)
    tables = T.mapped_sets(sets, norm_space=space, ts=space.select("ts_id", F.array("iqr", "mean").alias("values")))
    assert {k: df.count() for k, df in tables.items()} == {"info": 12, "norm_space": 12, "ts": 12}
    ids = sorted(r["ts_id"] for r in tables["norm_space"].filter("set_size = 8").collect())
    assert ids == [0, 1, 2, 3, 1_000_000, 1_000_001, 1_000_002, 1_000_003]
