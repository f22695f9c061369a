"""Sets of series and features as CSV folders, {field}_{size}, and back; parquet partitioned by set size for pipelines.

Every CSV holds a header and ts_id as its first column; series are written wide, one column a point, named by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABOUT = "Sets of series by field and size; the first column, ts_id, links the fields of one set."


def wide(series: DataFrame) -> DataFrame:
    """ts_id and one column a point; ragged series end in nulls. The number of points is found by one aggregate."""
    n = series.agg(F.max(F.size("values"))).first()[0] or 0
    return series.select("ts_id", *[F.get("values", F.lit(i)).alias(str(i)) for i in range(n)])


def long_arrays(table: DataFrame) -> DataFrame:
    """ts_id and values from the wide form; nulls (the ends of ragged series) go."""
    points = [F.col(f"`{c}`").cast("double") for c in table.columns[1:]]
    return table.select("ts_id", F.filter(F.array(*points), lambda x: x.isNotNull()).alias("values") if points else F.array().cast("array<double>").alias("values"))


def write_csv(sets: dict[str, dict[int, DataFrame]], path: str) -> None:
    """One CSV folder for each field and size, and a text that says what they are. Arrays named `values` are written wide."""
    for field, by_size in sets.items():
        for size, df in by_size.items():
            out = wide(df) if "values" in df.columns else df.select("ts_id", *[c for c in df.columns if c != "ts_id"])
            out.write.option("header", True).mode("overwrite").csv(f"{path}/{field}_{size}")
    spark = next(df for by_size in sets.values() for df in by_size.values()).sparkSession
    spark.createDataFrame([(ABOUT,)], "value string").write.mode("overwrite").text(f"{path}/README")


def read_csv(spark: SparkSession, path: str, field: str, size: int, schema: str | T.StructType | None = None) -> DataFrame:
    """A field of a set. Without a schema: ts_id as long, all else as double; whole-number headers are points of a series."""
    place = f"{path}/{field}_{size}"
    if schema is not None:
        return spark.read.option("header", True).schema(schema).csv(place)
    raw = spark.read.option("header", True).csv(place)
    first, *rest = raw.columns
    typed = raw.select(F.col(first).cast("long").alias("ts_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest])
    return long_arrays(typed) if rest and all(c.isdigit() for c in rest) else typed


def write_partitioned(by_size: dict[int, DataFrame], path: str) -> None:
    """All sizes of a field as one parquet table, partitioned by set_size."""
    for size, df in by_size.items():
        df.write.mode("overwrite").parquet(f"{path}/set_size={size}")


def read_partitioned(spark: SparkSession, path: str) -> dict[int, DataFrame]:
    """The sets by size; each is a scan of its own partition."""
    table = spark.read.parquet(path)
    sizes = sorted(r[0] for r in table.select("set_size").distinct().toLocalIterator())
    return {s: table.filter(F.col("set_size") == s).drop("set_size") for s in sizes}
