"""Exact percentiles of groups of any size, without all of a group's values in one task.

A sketch brackets each percentile between two values. A bracket's rows are cut at its own approximate quantiles, rows are counted at
and between the cuts and under the bracket, and what holds the order statistics asked for becomes the next bracket. Once a bracket holds few rows, these
alone are sorted. Cuts go by rank, so each pass leaves a like share of the rows whatever their values, and a value that repeats has a count of its own. Counts are exact, so a
bracket that misses its statistic shows it, and is replaced by the group's whole range. A group of few rows is sorted at once. What a task holds is bounded by the
sketch, the cuts and the rows of a last bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadscape.sources.store import kept

#: Rows of a bracket that are sorted together, cuts of a bracket, and the sketch's accuracy.
MOST, CUTS, ACCURACY = 1 << 16, 64, 10_000


def exact(rows: DataFrame, by: Sequence[str], probabilities: Sequence[float], value: str = "v", most: int = MOST, cuts: int = CUTS, accuracy: int = ACCURACY) -> DataFrame:
    """by, n and q (array<double>): each group's number of values, and its percentiles, interpolated linearly; a null or NaN value is none, and a group without values has no row."""
    by, v = list(by), F.col("_v")
    rows = rows.select(*by, F.col(value).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    slack = 2.0 / accuracy
    bounds = [x for p in probabilities for x in (max(0.0, p - slack), min(1.0, p + slack))]
    first = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo0"), F.max("_v").alias("hi0"), F.percentile_approx("_v", bounds, accuracy).alias("b"))
    few, targets = F.col("n") <= most, []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = (F.when(few | F.lit(end), F.col(whole)).otherwise(F.col("b")[2 * i + k]) for k, whole, end in ((0, "lo0", p <= slack), (1, "hi0", p >= 1 - slack)))
        targets.append(F.struct(F.lit(i).alias("i"), at.alias("at"), F.floor(at).alias("k0"), F.ceil(at).alias("k1"), lo.alias("lo"), hi.alias("hi"), F.when(few, F.lit(0)).cast("long").alias("below"), F.when(few, F.col("n")).alias("inside")))
    brackets = kept(first.select(*by, "n", "lo0", "hi0", F.explode(F.array(*targets)).alias("t")).select(*by, "n", "lo0", "hi0", "t.*"), "quantile-brackets")
    wide = F.col("below").isNull() | ((F.col("inside") > most) & (F.col("lo") < F.col("hi")))
    while not brackets.filter(wide).isEmpty():
        brackets = kept(brackets.filter(~wide).unionByName(_narrowed(rows, brackets.filter(wide), by, cuts, accuracy)), "quantile-brackets")
    return _resolved(rows, brackets, by)


def _on(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join by the group, null being a group as well."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return left.join(renamed, same).drop(*[f"_{c}" for c in by]) if by else left.join(F.broadcast(renamed))


def _narrowed(rows: DataFrame, brackets: DataFrame, by: list[str], cuts: int, accuracy: int) -> DataFrame:
    v = F.col("_v")
    under = _on(rows, brackets.select(*by, "i", "lo", "hi"), by).filter(v <= F.col("hi"))
    cut = under.filter(v >= F.col("lo")).groupBy(*by, "i").agg(F.array_distinct(F.percentile_approx("_v", [k / cuts for k in range(cuts + 1)], accuracy)).alias("cuts"))
    inside = _on(rows, _on(brackets.select(*by, "i", "lo", "hi"), kept(cut, "quantile-cuts").withColumnRenamed("i", "j"), by).filter("i = j"), by).filter(v <= F.col("hi"))
    smaller = F.size(F.filter("cuts", lambda x: x < v))
    # between two cuts, or at the upper one
    cell = F.when(v < F.col("lo"), -1).otherwise(2 * smaller + F.coalesce((F.get("cuts", smaller) == v).cast("int"), F.lit(0)))
    counts = inside.groupBy(*by, "i", cell.cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("first"), F.max("_v").alias("last"))
    upto = F.sum("c").over(Window.partitionBy(*by, "i").orderBy("cell"))  # one row a cell
    held = _on(counts.withColumn("upto", upto), brackets.select(*by, F.col("i").alias("_i"), "k0", "k1"), by).filter("i = _i and upto > k0 and upto - c <= k1")
    found = held.groupBy(*by, "i").agg(F.min("cell").alias("cell"), F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.col("upto") - F.col("c")).alias("before"), F.sum("c").alias("c"))
    renamed = found.withColumnsRenamed({c: f"_{c}" for c in [*by, "i"]})
    both = brackets.join(renamed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "i"]], "left")
    right = F.coalesce((F.col("cell") >= 0) & (F.col("before") <= F.col("k0")) & (F.col("before") + F.col("c") > F.col("k1")), F.lit(False))
    pick = lambda new, old: F.when(right, F.col(new)).otherwise(F.col(old) if old else F.lit(None))
    return both.select(*by, "n", "lo0", "hi0", "i", "at", "k0", "k1", pick("first", "lo0").alias("lo"), pick("last", "hi0").alias("hi"), pick("before", None).cast("long").alias("below"), pick("c", None).cast("long").alias("inside"))


def _resolved(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    one = F.col("lo") == F.col("hi")
    left = _on(rows, brackets.filter(~one), by).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
    lists = left.groupBy(*by, "n", "i", "at", "k0", "k1", "below").agg(F.sort_array(F.collect_list("_v")).alias("s"))
    found = lists.select(*by, "n", "i", "at", "k0", "k1", F.get("s", F.col("k0") - F.col("below")).alias("a"), F.get("s", F.col("k1") - F.col("below")).alias("b"))
    found = found.unionByName(brackets.filter(one).select(*by, "n", "i", "at", "k0", "k1", F.col("lo").alias("a"), F.col("lo").alias("b")))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("k1") - F.col("at")) * F.col("a") + (F.col("at") - F.col("k0")) * F.col("b"))
    return found.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("x")))), lambda t: t["x"]).alias("q"))


def of_columns(df: DataFrame, columns: list[str], probabilities: Sequence[float], **settings) -> dict[str, list[float | None]]:
    """The percentiles of some columns of all rows; a column without values has nulls. As many numbers as are asked for reach the driver."""
    long = df.select(*columns).unpivot([], columns, "feature", "v")
    found = {r["feature"]: list(r["q"]) for r in exact(long, ["feature"], probabilities, **settings).collect()}
    return {c: found.get(c, [None] * len(probabilities)) for c in columns}
