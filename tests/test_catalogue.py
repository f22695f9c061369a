import pytest

from loadscape.sources import catalogue as C

ROWS = """src;ID;IDtool;orig_name;rectified_name;use;norm_in;norm_out;comment;description;parse_info
tsfel;1;1;0_Centroid;temporal_centroid;true;norm_maxabs;;;where the energy is;temporal calc_centroid fs=1000
tsfel;2;2;0_Above;share_above_mean;true;z_score;len;;;temporal above
tsfel;3;3;0_Unused;unused;false;norm_maxabs;;;;spectral roll a=1 b=x
tsfresh;4;1;value__mean;mean;true;_dont_care;;;;
tsfresh;5;2;value__lag;lag;true;_dont_care;;;;lag=3
"""


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalogue") / "features.csv"
    path.write_text(ROWS)
    return C.read(spark, str(path))


def test_filters(table):
    ids = lambda df: sorted(r["ID"] for r in df.collect())
    assert ids(C.chosen(table, "tsfel")) == [1, 2] and ids(C.chosen(table, "tsfel", None)) == [1, 2, 3] and ids(C.chosen(table, "tsfel", False)) == [3]
    assert ids(C.chosen(table, "tsfel", None, ("norm_maxabs", "_dont_care"))) == [1, 3]


def test_parse_info(table):
    got = {r["orig_name"]: (r["domain"], r["function"], r["settings"], r["numbers"]) for r in C.parsed(table).collect()}
    assert got["0_Centroid"] == ("temporal", "calc_centroid", {"fs": "1000"}, {"fs": 1000.0})
    assert got["0_Above"] == ("temporal", "above", {}, {}) and got["value__mean"] == (None, None, {}, {})
    assert got["0_Unused"] == ("spectral", "roll", {"a": "1", "b": "x"}, {"a": 1.0, "b": None}) and got["value__lag"] == (None, None, {"lag": "3"}, {"lag": 3.0})


def test_names_and_lengths(spark, table):
    features = spark.createDataFrame([(7, 0.5, 500.0)], "ts_id long, `0_Centroid` double, `0_Above` double")
    named = C.renamed(C.per_point(features, table, 1000), table, "tsfel")
    assert named.first().asDict() == {"ts_id": 7, "temporal_centroid": 0.5, "share_above_mean": 0.5}
    with pytest.raises(KeyError):
        C.renamed(features.withColumnRenamed("0_Above", "other"), table)
