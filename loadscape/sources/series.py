"""Series and feature spaces made from the given tables.

A series is one row: ts_id and values (array<double>, the position is the time). The long form has one row a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEATURES = [f"f{i}" for i in range(8)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_df(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """A frame as it is, or the table at a path; anything else is an error."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return spark.read.parquet(source)
    raise ValueError(f"neither a DataFrame nor a path: {type(source).__name__}")


def by_kind(spark: SparkSession, source: str | dict[str, DataFrame | str], kinds: tuple[str, ...]) -> dict[str, DataFrame]:
    """Series or features of each kind: from one table partitioned by kind, of which only the kinds asked for are read, or from a frame or a path for each."""
    if isinstance(source, str):
        table = spark.read.parquet(source)
        if "kind" not in table.columns:
            raise ValueError(f"{source} is not partitioned by kind")
        return {k: table.filter(F.col("kind") == k).drop("kind") for k in kinds}
    missing = [k for k in kinds if k not in source]
    if missing:
        raise KeyError(f"not there: {', '.join(missing)}")
    return {k: as_df(spark, source[k]) for k in kinds}


def to_arrays(long: DataFrame) -> DataFrame:
    """(ts_id, values) from (ts_id, t, v); ragged lengths are kept."""
    points = F.array_sort(F.collect_list(F.struct("t", "v")))
    return long.groupBy("ts_id").agg(F.transform(points, lambda p: p["v"]).alias("values"))


def to_long(series: DataFrame, digits: int | None = None) -> DataFrame:
    """(ts_id, t, v) from (ts_id, values)."""
    out = series.select("ts_id", F.posexplode("values").alias("t", "v"))
    return out if digits is None else out.withColumn("v", F.round("v", digits) + F.lit(0.0))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ts_id"), (F.row_number().over(order) - 1).alias("t"), F.col("value").alias("v"))


def exact_sum(v: Column) -> Column:
    """The sum of amounts in hundredths, added as whole numbers, so that equal sums are equal whatever the order of rows; of other doubles, their sum."""
    whole = F.when(F.abs(v) < 1e9, F.rint(v * 100).cast("long"))
    return F.coalesce(F.when(F.bool_and(v.isNull() | F.coalesce(whole / F.lit(100.0) == v, F.lit(False))), F.try_sum(whole) / F.lit(100.0)), F.sum(v))


def sales_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's monthly sales on the grid of all months, 0 where there are none."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ts_id"), F.date_trunc("month", "l_shipdate").alias("month"), "l_extendedprice")
    # months are few (a calendar), so their grid is broadcast
    months = lines.select("month").distinct().withColumn("t", F.row_number().over(Window.orderBy("month")) - 1)
    sums = lines.groupBy("ts_id", "month").agg(exact_sum(F.col("l_extendedprice")).alias("v"))
    grid = lines.select("ts_id").distinct().crossJoin(F.broadcast(months))
    return grid.join(sums, ["ts_id", "month"], "left").select("ts_id", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_arrays(event_points(spark, sf_dir))


def sales_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_arrays(sales_points(spark, sf_dir))


def raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_id, label and eight features from the first components of the vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ts_id"), "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(FEATURES)])


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to [0, 1] by its own extremes: one aggregate, one row broadcast. A constant column becomes null."""
    ends = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [((F.col(c) - F.col(f"{c}_lo")) / F.nullif(F.col(f"{c}_hi") - F.col(f"{c}_lo"), F.lit(0.0))).alias(c) for c in columns]
    return df.crossJoin(F.broadcast(ends)).select(*[c for c in df.columns if c not in columns], *scaled)


def feature_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_max(raw_features(spark, sf_dir), FEATURES)
