"""A catalogue compiled to one plan, against the single families and plain values."""

import random

import numpy as np
import pytest

from loadscape.operators import compiled
from loadscape.operators import features as X
from loadscape.sources import catalogue as C
from loadscape.sources.series import to_long


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, [rng.choice((rng.gauss(0, 1), round(rng.gauss(0, 1), 1))) for _ in range(rng.choice((30, 47, 80)))]) for i in range(12)]
    rows.append((99, [0.3, -0.3] * 20))
    path = str(tmp_path_factory.mktemp("series") / "s")
    spark.createDataFrame(rows, "ts_id long, values array<double>").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_every_feature_equals_its_family(spark, series):
    points = to_long(series)
    want = {r["ts_id"]: r for r in X.all_features(series, points).collect()}
    got = compiled.features(series, compiled.rows_of(spark, compiled.all_rows())).collect()
    names = set(got[0].asDict()) - {"ts_id"}
    assert names == set(want[0].asDict()) - {"ts_id"} and len(got) == 13
    for r in got:
        for n in names:
            a, b = r[n], want[r["ts_id"]][n]
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 2e-6), (r["ts_id"], n, a, b)


def test_one_scan_and_no_exchange(spark, series):
    plan = compiled.features(series, compiled.rows_of(spark, compiled.all_rows()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and plan.count("MapInPandas") == 1


CATALOGUE = """src;ID;IDtool;orig_name;rectified_name;use;norm_in;norm_out;comment;description;parse_info
tsfel;1;1;0_Centroid;centroid;true;norm_maxabs;;;;temporal temporal_centroid fs=10
tsfel;2;2;0_Low;p10;true;z_score;;;;statistical quantile q=0.1
tsfel;3;3;0_Unused;unused;false;norm_maxabs;;;;spectral nowhere a=1
kats;4;1;linearity;trend;true;z_score;;;;
tsfresh;5;1;value__count_above_mean;above;true;_dont_care;len;;;x count_above_mean
extra;6;1;dfa;dfa;true;_dont_care;;;;
"""


def table(spark, path, text):
    path.write_text(text)
    return C.read(spark, str(path))


def test_rows_of_a_file(spark, series, tmp_path):
    cat = table(spark, tmp_path / "c.csv", CATALOGUE)
    df = compiled.features(series, cat)
    assert df.columns == ["ts_id", "centroid", "p10", "trend", "above", "dfa"]
    values = {r["ts_id"]: np.array(r["values"]) for r in series.collect()}
    for r in df.collect():
        v = values[r["ts_id"]]
        z = (v - v.mean()) / v.std()
        assert abs(r["centroid"] - (np.arange(len(v)) / 10 * v * v).sum() / (v * v).sum()) < 2e-6
        assert abs(r["p10"] - np.percentile(z, 10)) < 2e-6 and abs(r["above"] - (v > v.mean()).mean()) < 2e-6
        assert abs(r["trend"] - np.corrcoef(np.arange(len(v)), v)[0, 1] ** 2) < 2e-6
    assert compiled.features(series, cat, "tsfel").columns == ["ts_id", "centroid", "p10"]


@pytest.mark.parametrize("line", ["kats;7;1;nowhere;x;true;;;;;", "tsfel;7;1;a;x;true;sideways;;;;t iqr", "tsfel;7;1;a;x;true;;;;;t quantile p=1", "tsfel;7;1;a;x;true;;;;;t quantile q=y", "kats;7;1;iqr;trend;true;;;;;"])
def test_what_a_catalogue_cannot_say(spark, series, tmp_path, line):
    with pytest.raises(KeyError):
        compiled.features(series, table(spark, tmp_path / "c.csv", CATALOGUE + line + "\n"))


def test_short_and_constant_series(spark):
    rows = [(1, []), (2, [1.0]), (3, [2.0] * 40), (4, [0.0, 0.0])]
    df = compiled.features(spark.createDataFrame(rows, "ts_id long, values array<double>"), compiled.rows_of(spark, [n for n in compiled.all_rows() if isinstance(n, tuple) or n in compiled.X.FEATURES]))
    got = {r["ts_id"]: r for r in df.collect()}
    assert got[1]["mean"] is None and got[1]["iqr"] is None and got[2]["mean"] == 1.0 and got[2]["mean3_stderr"] is None and got[2]["acf_timescale"] is None
    assert got[3]["mode5"] == 2.0 and got[3]["ami2"] == 0.0 and got[3]["linearity"] is None and got[3]["motif_entropy"] == 0.0 and got[4]["crest"] is None
