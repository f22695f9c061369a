import numpy as np
import pytest

from loadscape.functions import shape_kernels as H
from loadscape.operators import features as X
from loadscape.sources import sets as S

T = np.arange(140.0)
NOISE = np.random.default_rng(1).normal(size=140)


def test_periodicity_finds_the_period_of_a_wave_on_a_slope():
    assert H.periodicity(np.sin(2 * np.pi * T / 20) + T / 50) == pytest.approx(20, abs=1)
    assert H.periodicity(T**3) == 0


def test_seasonal_part_of_a_weekly_pattern():
    week = np.tile([0, 1, 2, 6, 2, 1, -3.0], 20)
    found = H.shape_features(week + T / 100)
    assert found["stl_seasonality_strength"] > 0.99 and found["stl_peak"] == 3 and found["stl_trough"] == 6
    assert H.shape_features(NOISE)["stl_seasonality_strength"] < 0.5
    trend, season, rest = H.decompose(NOISE)
    assert np.allclose(trend + season + rest, NOISE)


def test_leave_one_out_equals_plain_variances():
    assert np.allclose(H.leave_one_out(NOISE[:20]), [np.delete(NOISE[:20], i).var(ddof=1) for i in range(20)])


def test_loess_keeps_lines():
    assert np.allclose(H.loess(3 + 2 * T, 11), 3 + 2 * T)


def test_changes_are_seen():
    step = np.where(T < 70, 0.0, 8.0) + NOISE * 0.3
    assert H.robust_changes(step) == 1
    assert H.change_confidence(step) > 0.9 > 0.5 > H.change_confidence(NOISE)


def test_timing_of_outliers():
    late, early = np.where(T > 120, 5.0, 0.0) + NOISE * 0.1, np.where(T < 20, 5.0, 0.0) + NOISE * 0.1
    assert H.outlier_timing(late, 1) > 0.7 and H.outlier_timing(early, 1) < -0.7
    assert H.outlier_timing(-late, -1) == pytest.approx(H.outlier_timing(late, 1))


def test_transitions_of_an_alternating_series():
    v = np.tile([0.0, 1.0], 50)
    moves = np.zeros((3, 3))
    for a, b in zip(v[:-1], v[1:]):
        moves[int(a) * 1, int(b) * 1] += 1 / 99
    assert H.transition_variance(v, 1) == pytest.approx(np.cov(moves.T).trace(), abs=1e-9)


@pytest.mark.parametrize("v", [[], [1.0], [2.0] * 50, [np.nan] * 30])
def test_series_without_shape_give_nulls(v):
    assert all(np.isnan(x) for x in H.shape_features(np.array(v)).values())


def test_shapes_and_any_callable_on_a_table(spark):
    df = spark.createDataFrame([(1, NOISE.tolist()), (2, [1.0] * 30)], "ts_id long, values array<double>")
    found = {r["ts_id"]: r for r in X.shapes(df).collect()}
    assert found[2]["periodicity"] is None and found[1]["ami_timescale"] >= 1
    own = X.per_series(df, lambda v: {"n": float(len(v))}, ("n", "absent"))
    assert sorted(map(tuple, own.collect())) == [(1, 140.0, None), (2, 30.0, None)]


def test_sets_go_to_csv_and_back(spark, tmp_path):
    series = spark.createDataFrame([(1, [0.5, -1.0, 0.25]), (2, [1.0])], "ts_id long, values array<double>")
    features = spark.createDataFrame([(0.5, 1), (None, 2)], "mean double, ts_id long")
    S.write_csv({"ts": {2: series}, "features": {2: features}}, str(tmp_path))
    assert sorted(map(tuple, S.read_csv(spark, str(tmp_path), "ts", 2).collect())) == [(1, [0.5, -1.0, 0.25]), (2, [1.0])]
    back = S.read_csv(spark, str(tmp_path), "features", 2)
    assert back.columns == ["ts_id", "mean"] and sorted(map(tuple, back.collect())) == [(1, 0.5), (2, None)]


def test_sets_partitioned_by_size(spark, tmp_path):
    S.write_partitioned({4: spark.range(4), 2: spark.range(2)}, f"{tmp_path}/sets")
    assert {k: v.count() for k, v in S.read_partitioned(spark, f"{tmp_path}/sets").items()} == {2: 2, 4: 4}
