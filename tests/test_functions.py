import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscape.functions import arrays as A
from loadscape.functions import kernels as K
from loadscape.operators import decluster as D
from loadscape.operators import features as X
from loadscape.operators import recombine as R
from loadscape.operators import space as S
from loadscape.sources import series as src


def one(spark, values, change):
    return spark.createDataFrame([(1, [float(x) for x in values])], "ts_id long, values array<double>").select(change(F.col("values"))).first()[0]


@pytest.mark.parametrize(
    "values, change, expected",
    [
        ([1, -2, 0.5], A.norm_maxabs, [0.5, -1, 0.25]),
        ([1, 2, 3], A.norm_meanmaxabs, [-1, 0, 1]),
        ([2, 4, 6], A.norm_minmax, [0, 0.5, 1]),
        ([1, 0, -1], lambda v: A.shift(v, -1.0), [0, -0.5, -1]),
        ([1, -0.5], lambda v: A.expand(v, 2.0), [1, -0.25]),
        ([0, 1, 2], lambda v: A.curtail_top(v, 0.5), [0, 1, 1]),
        ([0, 1, 2], lambda v: A.curtail_bottom(v, 0.5), [0.5, 0.5, 1]),
        ([-1, 0, 1], lambda v: A.curtail_middle(v, 0.5), [-1, 0, 1]),
        ([1, -1], A.fix_sign_negative, [0, -1]),
        ([1, 2], lambda v: A.append_overlapping(v, F.array(F.lit(3.0), F.lit(4.0)), 1), [1, 5, 4]),
    ],
)
def test_micro_vectors(spark, values, change, expected):
    assert one(spark, values, change) == pytest.approx(expected)


def test_zero_series_cannot_be_scaled(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, [0, 0], A.norm_maxabs)


def test_pchip_keeps_knots_and_monotony():
    x, y = np.array([0, 1, 2.5, 4, 7]), np.array([0, 1, 1.2, 3, 3.1])
    fine = np.linspace(0, 7, 500)
    assert K.pchip(x, y, x) == pytest.approx(y)
    assert (np.diff(K.pchip(x, y, fine)) >= -1e-12).all()


def test_bounds_are_fixed():
    rng = np.random.default_rng(0)
    v = rng.normal(-0.3, 1, 100)
    out = K.fix_bounds(v)
    assert K.bounds_valid(out) and np.abs(out).max() == 1


def test_average_linkage_labels():
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    assert K.average_linkage(d, 0.5).tolist() == [1, 1, 2]


def test_histogram_edges_and_heterogeneity(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.3, 1.0)], "f double")
    assert sorted((r["bin"]) for r in S.nd_hist(df, ["f"]).filter("freq > 0").collect()) == [0, 1, 2, 9]
    even = spark.createDataFrame([(0.05 + i / 10,) for i in range(10)], "f double")
    assert S.heterogeneity(even, ["f"]).first()[0] == pytest.approx(0)
    assert S.heterogeneity(spark.createDataFrame([(0.5,)] * 4, "f double"), ["f"]).first()[0] == pytest.approx(1)


def test_chain_text_round_trip_and_draws(spark):
    lines = spark.createDataFrame([("7 |> shift:-0.50 | exp:1.30",), ("8 |> ",)], "line string")
    chains = R.parse_chains(lines)
    assert [r["src_id"] for r in chains.orderBy("src_id").collect()] == [7, 8]
    assert R.chain_text(chains).orderBy("line").first()[0] == "7 |> shift:-0.50 | exp:1.30"
    ids = spark.range(100)
    assert ids.select(R.draw(1, "id", 2)).collect() == ids.repartition(7).orderBy("id").select(R.draw(1, "id", 2)).collect()


def test_manifold_keeps_its_constraints(spark):
    rng = np.random.default_rng(1)
    start = spark.createDataFrame([(i, rng.normal(0, 1, 60).tolist()) for i in range(4)], "ts_id long, values array<double>")
    out = R.manifold(start, "only_neg", samples=60, n_concat=4, n_superpos=4, per_series=2).collect()
    assert out
    for r in out:
        v = np.array(r["values"])
        assert v.mean() < 0 and np.abs(v).max() == 1 and (v <= 0).all() and K.bounds_valid(v)


def test_sources_reject_other_types(spark):
    with pytest.raises(ValueError):
        src.as_df(spark, 3)


def test_constant_slices_and_hashed_ids(spark):
    rng = np.random.default_rng(2)
    raw = spark.createDataFrame([("a", [1.0] * 80), ("b", rng.normal(0, 1, 80).tolist()), ("c", [None, float("nan")] * 40)], "name string, values array<double>")
    picked = spark.createDataFrame([(n, 0, 60) for n in "abc"], "name string, start int, stop int")
    cut = R.cut_selections(raw, picked, 50)
    rows = cut.collect()
    assert len(rows) == 3 and all(abs(np.mean(r["values"])) < 1e-9 and np.abs(r["values"]).max() == 1 for r in rows)
    assert rows and cut.collect() == rows
    recipes = R.chain_recipes(cut, 8)
    assert recipes.select("out_id").distinct().count() == 24 and R.modify(cut, recipes).count() == 24
    assert D.sample(cut.select("ts_id"), 2).count() == 2


def test_every_lag_is_looked_at(spark):
    slow = [float(np.cos(2 * np.pi * t / 200)) for t in range(400)]
    points = src.to_long(spark.createDataFrame([(1, slow), (2, [1.0, 1.0]), (3, [2.0])], "ts_id long, values array<double>"))
    got = {r["ts_id"]: (r["acf_timescale"], r["acf_first_zero"], r["acf_first_min"]) for r in X.acf_features(points).collect()}
    x = np.array(slow) - np.mean(slow)
    r = [float(x[:-k] @ x[k:] / (x @ x)) for k in range(1, 400)]
    assert got[1][:2] == (next(k + 1 for k, v in enumerate(r) if v < 1 / np.e), next(k + 1 for k, v in enumerate(r) if v <= 0)) and got[1][0] > 20 and got[1][2] > 60


def test_bounds_are_fixed_without_a_limit_of_rounds():
    rng = np.random.default_rng(5)
    for _ in range(50):
        v = K.fix_bounds(rng.normal(-0.05, 1, 200))
        assert np.isfinite(v).all() and abs(np.abs(v).max() - 1) < 1e-12
        assert K.bounds_valid(v)
