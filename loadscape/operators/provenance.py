"""Where the series of a pool come from: labels, and initial series behind each, through recipes upon recipes.

Recipes are tables of (out_id, src_id, ...). A series made of others is named by its pool and its number there, as the pool itself names it, so recipes of
several levels are one table of (ts_id, src_id). What lies behind a series is found by joining that table with itself from source to source until only
initial series are left; a step is a join of tables, and as many are made as recipes lie upon each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.operators import recombine as R
from loadscape.sources.store import kept

POOLS = ("concat", "superpos")


def named(pool: str, number: str = "out_id") -> F.Column:
    """The id of a pool's series."""
    return F.xxhash64(F.lit(pool), number)


def sources(recipes: dict[str, DataFrame]) -> DataFrame:
    """ts_id and src_id of all that is made: by `concat` and `superpos`, whose series are named by their pool, and by `chains`, whose out_id is the id."""
    parts = [recipes[p].select(named(p).alias("ts_id"), F.col("src_id").cast("long").alias("src_id")) for p in POOLS if p in recipes]
    if "chains" in recipes:
        parts.append(recipes["chains"].select(F.col("out_id").alias("ts_id"), F.col("src_id").cast("long").alias("src_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def labels(initial: DataFrame, recipes: dict[str, DataFrame]) -> DataFrame:
    """ts_id and label: an initial series' own id; 'concat' or 'superpos' and the recipe's line; the chain's line."""
    text = {"concat": R.concat_text, "superpos": R.superposition_text}
    out = initial.select("ts_id", F.col("ts_id").cast("string").alias("label"))
    for pool in (p for p in POOLS if p in recipes):
        out = out.unionByName(text[pool](recipes[pool]).select(named(pool).alias("ts_id"), F.concat(F.lit(f"{pool} "), "line").alias("label")))
    if "chains" in recipes:
        out = out.unionByName(recipes["chains"].select(F.col("out_id").alias("ts_id"), R.chain_line().alias("label")))
    return out


def traced(made: DataFrame, initial: DataFrame, most: int = 32) -> DataFrame:
    """ts_id, src_id (an initial series) and depth (the longest way to it) for every series in made (ts_id, src_id) and every initial one behind it.

    A source that is neither made nor initial is an error, and so are recipes that lie more than `most` upon each other, as those in a circle do.
    """
    first = initial.select(F.col("ts_id").alias("src_id")).distinct().withColumn("initial", F.lit(True))
    steps = kept(made.select("ts_id", "src_id").distinct().join(first, "src_id", "left").select("ts_id", "src_id", F.coalesce("initial", F.lit(False)).alias("initial")), "recipe-steps")
    below = steps.select(F.col("ts_id").alias("src_id"), F.col("src_id").alias("next"), F.col("initial").alias("next_initial"))
    open_, done = steps.filter("not initial").select("ts_id", "src_id"), steps.filter("initial").select("ts_id", "src_id", F.lit(1).alias("depth"))
    for depth in range(2, most + 1):
        if open_.isEmpty():
            return done.groupBy("ts_id", "src_id").agg(F.max("depth").alias("depth"))
        found = kept(open_.join(below, "src_id", "left").select("ts_id", "src_id", "next", "next_initial").distinct(), "recipe-sources")
        lost = found.filter("next is null").select("src_id").first()
        if lost:
            raise KeyError(f"no series {lost[0]}, neither initial nor made")
        done = done.unionByName(found.filter("next_initial").select("ts_id", F.col("next").alias("src_id"), F.lit(depth).alias("depth")).distinct())
        open_ = found.filter("not next_initial").select("ts_id", F.col("next").alias("src_id")).distinct()
    if open_.isEmpty():
        return done.groupBy("ts_id", "src_id").agg(F.max("depth").alias("depth"))
    raise ValueError(f"recipes lie more than {most} upon each other")


def origins(made: DataFrame, initial: DataFrame) -> DataFrame:
    """ts_id, initial_ids (in order) and depth of every made series and of every initial one, which has itself behind it at depth 0."""
    behind = traced(made, initial).groupBy("ts_id").agg(F.array_sort(F.collect_list("src_id")).alias("initial_ids"), F.max("depth").alias("depth"))
    own = initial.select("ts_id").distinct()
    return behind.unionByName(own.select("ts_id", F.array("ts_id").alias("initial_ids"), F.lit(0).alias("depth")))


def recombined(initial: DataFrame, recipes: dict[str, DataFrame]) -> DataFrame:
    """ts_id, label, initial_ids and depth of a pool: its initial series, and all that its recipes make."""
    return labels(initial, recipes).join(origins(sources(recipes), initial), "ts_id").select("ts_id", "label", "initial_ids", "depth")
