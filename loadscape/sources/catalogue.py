"""The catalogue of features: a table of one row a feature, its filters, and what its parse_info column says.

Columns: src, ID, IDtool, orig_name, rectified_name, use, norm_in, norm_out, comment, description, parse_info.
parse_info is '<domain> <function> [k=v ...]' for tsfel and '[k=v ...]' for tsfresh.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "src string, ID int, IDtool int, orig_name string, rectified_name string, use boolean, norm_in string, norm_out string, comment string, description string, parse_info string"


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).schema(schema).csv(path)


def chosen(catalogue: DataFrame, src: str, use: bool | None = True, norm_in: tuple[str, ...] | None = None) -> DataFrame:
    """The features of a toolbox; use None: used or not; norm_in: only those whose input is normalised in one of these ways."""
    out = catalogue.filter(F.col("src") == src)
    if use is not None:
        out = out.filter(F.col("use") == use)
    return out if norm_in is None else out.filter(F.col("norm_in").isin(*norm_in))


def _settings(words: Column) -> Column:
    """A map from 'k=v' words, values as text; empty where there are none."""
    pairs = F.transform(F.filter(words, lambda w: w.contains("=")), lambda w: F.struct(F.split_part(w, F.lit("="), F.lit(1)), F.split_part(w, F.lit("="), F.lit(2))))
    return F.map_from_entries(pairs)


def parsed(catalogue: DataFrame) -> DataFrame:
    """src, orig_name, domain and function (null unless named), settings (name to text) and numbers (name to double; text that is none gives null)."""
    words = F.filter(F.split(F.coalesce("parse_info", F.lit("")), " "), lambda w: w != "")
    plain = F.filter(words, lambda w: ~w.contains("="))
    rows = catalogue.select("src", "orig_name", F.get(plain, F.lit(0)).alias("domain"), F.get(plain, F.lit(1)).alias("function"), _settings(words).alias("settings"))
    return rows.withColumn("numbers", F.transform_values("settings", lambda k, v: v.try_cast("double")))


def renamed(features: DataFrame, catalogue: DataFrame, src: str | None = None, key: str = "ts_id") -> DataFrame:
    """Columns under their rectified names; a column that the catalogue lacks is an error. The catalogue has one row a feature, so its names are collected."""
    rows = catalogue if src is None else chosen(catalogue, src)
    names = {r[0]: r[1] for r in rows.select("orig_name", "rectified_name").collect()}
    missing = [c for c in features.columns if c != key and c not in names]
    if missing:
        raise KeyError(f"not in the catalogue: {', '.join(missing)}")
    return features.withColumnsRenamed({c: names[c] for c in features.columns if c != key})


def per_point(features: DataFrame, catalogue: DataFrame, n_points: int) -> DataFrame:
    """Features whose norm_out is set, divided by the number of points of a series; matched by name."""
    scaled = {r[0] for r in catalogue.filter(F.col("norm_out").isNotNull()).select("orig_name").collect()}
    return features.select(*[(F.col(c) / n_points).alias(c) if c in scaled else F.col(c) for c in features.columns])
