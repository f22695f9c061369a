"""Numbers and running sums along long series, with no task that holds a whole one.

Rows are put in order by one range partition of all. A row's number in its series is its place among the series' rows in its partition and their number in the
partitions before. A running sum is the sum in its block of following rows and the sums of the blocks before, which are few and are added up apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadscape.sources.store import kept

BLOCK = 1 << 16


def numbered(df: DataFrame, by: str, *order: str, column: str = "t", partitions: int | None = None) -> DataFrame:
    """df with each row's number (from 0) in its series in the given order; rows that are equal in it are numbered in any order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, by, *order).sortWithinPartitions(by, *order)
    # such an id is the partition's number, then the row's in it
    placed = kept(placed.withColumn("_place", F.monotonically_increasing_id()), "ordered-rows").withColumn("_part", F.shiftright("_place", 33))
    spans = placed.groupBy(by, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition that the series is in
    starts = spans.select(F.col(by).alias("_by"), F.col("_part").alias("_at"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = placed.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn(column, F.col("_start") + F.col("_place") - F.col("_first")).drop("_place", "_part", "_by", "_at", "_first", "_start")


def running(points: DataFrame, column: str = "sum", value: str = "v", by: str = "ts_id", order: str = "t", falling: bool = False, block: int = BLOCK) -> DataFrame:
    """points with the running sum of a value in the order of t, rising or falling; t is a row's number in its series, and a null value adds nothing."""
    direction = lambda c: c.desc() if falling else c.asc()
    rows = points.withColumn("_block", F.floor(F.col(order) / block))
    sums = rows.groupBy(by, "_block").agg(F.sum(value).alias("_all"))
    before = Window.partitionBy(by).orderBy(direction(F.col("_block"))).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = sums.select(F.col(by).alias("_by"), F.col("_block").alias("_at"), F.coalesce(F.sum("_all").over(before), F.lit(0.0)).alias("_start"))
    own = F.sum(value).over(Window.partitionBy(by, "_block").orderBy(direction(F.col(order))))
    joined = rows.withColumn("_own", own).join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_at")))
    return joined.withColumn(column, F.coalesce(F.col("_own"), F.lit(0.0)) + F.col("_start")).drop("_block", "_own", "_by", "_at", "_start")


def of_all(df: DataFrame, *order: Column, column: str = "pos", partitions: int | None = None) -> DataFrame:
    """df with each row's number (from 0) in an order of all rows."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = kept(placed.withColumn("_place", F.monotonically_increasing_id()), "ordered-rows").withColumn("_part", F.shiftright("_place", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = placed.groupBy("_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")).select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn(column, F.col("_start") + F.col("_place") - F.col("_first")).drop("_place", "_part", "_first", "_start")
