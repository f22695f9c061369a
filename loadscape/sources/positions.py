"""Rows by their position in a table of files, and tables attached to each other by it.

A row's position is its index in its file and the rows of the files before that, in the order of their names. Only the numbers of rows by file are added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positioned(spark: SparkSession, path: str, column: str = "pos") -> DataFrame:
    """The parquet table at path, with the position of each row."""
    rows = spark.read.parquet(path)
    if column in rows.columns:
        raise ValueError(f"there is a column {column} already")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = files.select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn(column, F.col("_start") + F.col("_index")).drop("_file", "_index", "_start")


def attached(spark: SparkSession, left: str, right: str, column: str = "pos") -> DataFrame:
    """Rows of the tables at two paths side by side by position; tables of different lengths, and names that clash, are errors."""
    sizes = [spark.read.parquet(p).count() for p in (left, right)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"{left} has {sizes[0]} rows, {right} {sizes[1]}")
    a, b = (positioned(spark, p, column) for p in (left, right))
    clash = set(a.columns) & set(b.columns) - {column}
    if clash:
        raise ValueError(f"in both: {', '.join(sorted(clash))}")
    return a.join(b, column)
