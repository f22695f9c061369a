"""Sums of amounts that do not depend on the order of rows."""

from datetime import datetime

from pyspark.sql import functions as F

from loadscape.sources import series


def test_months_of_equal_sales_are_equal(spark, tmp_path):
    months = [[0.1, 0.2], [0.3], [0.2, 0.1], [10.1, 0.2, 0.3], [0.3, 10.1, 0.2], [10.6], [None, 0.3], [0.7, 0.1, -0.5]]
    rows = [(1, datetime(2000, 1 + m, 1 + d), x) for m, prices in enumerate(months) for d, x in enumerate(prices)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {r["t"]: r["v"] for r in series.sales_points(spark, str(tmp_path)).collect()}
    assert [found[t] for t in range(8)] == [0.3, 0.3, 0.3, 10.6, 10.6, 10.6, 0.3, 0.3]


def test_other_doubles_have_their_usual_sum(spark):
    groups = {"thirds": [1 / 3, 1 / 3], "large": [1e300, 1.0], "many": [999999999.99] * 3, "infinite": [float("inf"), 1.0], "nan": [float("nan"), 1.0], "none": [None, None], "mixed": [0.5, 0.123456789]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, x double")
    for r in df.groupBy("k").agg(series.exact_sum(F.col("x")).alias("got"), F.sum("x").alias("want")).collect():
        assert repr(r["got"]) == repr(r["want"]) or r["k"] == "many" and r["got"] == 2999999999.97
