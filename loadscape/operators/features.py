"""Features of a series: native expressions where SQL can say them, one Arrow function for the numerical rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadscape.functions import arrays as A
from loadscape.functions import kernels as K
from loadscape.functions import shape_kernels

DIGITS = 6


def _t():
    return Window.partitionBy("ts_id").orderBy("t")


def _s():
    return Window.partitionBy("ts_id")


def rounded(c: Column) -> Column:
    return F.round(c, DIGITS) + F.lit(0.0)


def amplitude(series: DataFrame) -> DataFrame:
    """arv, crest, shape, impulse and clearance; null for a series of zeros."""
    v, n = F.col("values"), F.size("values")
    stats = series.select(
        "ts_id",
        A.max_abs(v).alias("peak"),
        (A.total(F.transform(v, lambda x: F.abs(x))) / n).alias("arv"),
        F.sqrt(A.total(F.transform(v, lambda x: x * x)) / n).alias("rms"),
        (A.total(F.transform(v, lambda x: F.sqrt(F.abs(x)))) / n).alias("root"),
    )
    ratio = lambda a, b: rounded(F.try_divide(F.col(a), b))
    return stats.select("ts_id", rounded(F.col("arv")).alias("arv"), ratio("peak", F.col("rms")).alias("crest"), ratio("rms", F.col("arv")).alias("shape"), ratio("peak", F.col("arv")).alias("impulse"), ratio("peak", F.col("root") * F.col("root")).alias("clearance"))


def differences(points: DataFrame) -> DataFrame:
    """Features of first and second differences; trev is the mean cubed difference, pnn40 the share of steps over 0.04."""
    d = points.select("ts_id", (F.col("v") - F.lag("v").over(_t())).alias("d"), ((F.lead("v").over(_t()) - 2 * F.col("v") + F.lag("v").over(_t())) / 2).alias("d2"))
    return d.groupBy("ts_id").agg(
        rounded(F.avg(F.pow("d", F.lit(3.0)))).alias("trev"),
        rounded(F.avg((F.abs("d") > 0.04).cast("double"))).alias("pnn40"),
        rounded(F.avg("d")).alias("mean_signed_diff"),
        rounded(F.percentile("d", F.lit(0.5))).alias("median_signed_diff"),
        rounded(F.percentile(F.abs("d"), F.lit(0.5))).alias("median_abs_diff"),
        rounded(F.avg("d2")).alias("mean_2nd_diff"),
        rounded(F.avg(F.abs("d"))).alias("mean_abs_diff"),
    )


def locations(points: DataFrame) -> DataFrame:
    """Relative places of the first and the last maximum, and the temporal centroid (step 0.001)."""
    p = points.withColumn("n", F.count(F.lit(1)).over(_s())).withColumn("top", F.max("v").over(_s()))
    at = F.when(F.col("v") == F.col("top"), F.col("t"))
    squares = F.sum(F.col("v") * F.col("v"))
    centroid = F.try_divide(F.sum(F.col("t") / 1000.0 * F.col("v") * F.col("v")), squares)
    return p.groupBy("ts_id").agg(rounded(F.min(at) / F.max("n")).alias("loc_first_max"), rounded((F.max(at) + 1) / F.max("n")).alias("loc_last_max"), rounded(centroid).alias("temporal_centroid"))


def levels(points: DataFrame) -> DataFrame:
    p = points.withColumn("m", F.avg("v").over(_s())).withColumn("before", F.lag("v").over(_t()))
    above, crossing = (F.col("v") > F.col("m")).cast("double"), F.coalesce((F.signum("v") != F.signum("before")).cast("long"), F.lit(0))
    return p.groupBy("ts_id").agg(
        rounded(F.avg("v")).alias("mean"),
        rounded(F.stddev_pop("v")).alias("std"),
        rounded(F.min("v")).alias("min"),
        rounded(F.max("v")).alias("max"),
        rounded(F.max("v") - F.min("v")).alias("peak2peak"),
        rounded(F.avg(above)).alias("share_above_mean"),
        rounded(F.avg(F.abs(F.col("v") - F.col("m")))).alias("mean_diff_from_mean"),
        rounded(F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))).alias("iqr"),
        F.sum(crossing).alias("cross_zero"),
    )


def longest_runs(points: DataFrame) -> DataFrame:
    """Longest runs above the mean and of falling steps: gaps and islands."""
    flags = points.select("ts_id", "t", (F.col("v") > F.avg("v").over(_s())).alias("high"), F.coalesce(F.col("v") < F.lag("v").over(_t()), F.lit(False)).alias("falls"))

    def longest(flag: str, name: str) -> DataFrame:
        island = flags.filter(flag).withColumn("g", F.col("t") - F.row_number().over(_t()))
        return island.groupBy("ts_id", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("ts_id").agg(F.max("n").alias(name))

    ids = points.select("ts_id").distinct()
    out = ids.join(longest("high", "longest_above_mean"), "ts_id", "left").join(longest("falls", "longest_decrease"), "ts_id", "left")
    return out.na.fill(0, ["longest_above_mean", "longest_decrease"])


def histogram_mode(points: DataFrame, bins: int) -> DataFrame:
    """Centre of the fullest of equal bins over the range; ties are averaged."""
    p = points.withColumn("lo", F.min("v").over(_s())).withColumn("w", (F.max("v").over(_s()) - F.min("v").over(_s())) / bins)
    b = F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("w"), F.lit(0.0))), F.lit(bins - 1))
    counts = p.withColumn("b", F.coalesce(b, F.lit(0))).groupBy("ts_id", "b").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.min("w").alias("w"))
    full = counts.withColumn("most", F.max("n").over(_s())).filter("n = most")
    return full.groupBy("ts_id").agg(rounded(F.avg(F.col("lo") + (F.col("b") + 0.5) * F.col("w"))).alias(f"mode{bins}"))


def autocorrelations(points: DataFrame, lags: int | None = None) -> DataFrame:
    """(ts_id, lag, r) of every lag of a series, or of the first ones; r is null for a constant series."""
    # one array a series: all its lags are sums over shifted slices, with no window and no join
    rows = points.groupBy("ts_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("v"))
    rows = rows.select("ts_id", A.let(A.mean(F.col("v")), lambda m: F.transform("v", lambda x: x - m)).alias("x"))
    n, total = F.size("x"), lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
    last = n - 1 if lags is None else F.least(n - 1, F.lit(lags))
    shifted = lambda k: total(F.zip_with(F.slice("x", F.lit(1), n - k), F.slice("x", k + 1, n - k), lambda p, q: p * q))
    every = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: shifted(k)))
    found = rows.select("ts_id", total(F.transform("x", lambda x: x * x)).alias("e"), F.posexplode(every).alias("lag", "sum"))
    return found.select("ts_id", (F.col("lag") + 1).alias("lag"), F.try_divide("sum", "e").alias("r"))


def acf_features(points: DataFrame, lags: int | None = None) -> DataFrame:
    """First lag under 1/e, first lag at or under 0, first local minimum, over all lags; null where there is none."""
    w = Window.partitionBy("ts_id").orderBy("lag")
    r = autocorrelations(points, lags).withColumn("before", F.coalesce(F.lag("r").over(w), F.lit(1.0))).withColumn("after", F.lead("r").over(w))
    first = lambda c, n: F.min(F.when(c, F.col("lag"))).alias(n)
    return r.groupBy("ts_id").agg(first(F.col("r") < 1 / np.e, "acf_timescale"), first(F.col("r") <= 0, "acf_first_zero"), first((F.col("r") < F.col("before")) & (F.col("r") < F.col("after")), "acf_first_min"))


def trend(points: DataFrame) -> DataFrame:
    n, x, y = F.count(F.lit(1)), F.col("t").cast("double"), F.col("v")
    cov, vx, vy = n * F.sum(x * y) - F.sum(x) * F.sum(y), n * F.sum(x * x) - F.sum(x) * F.sum(x), n * F.sum(y * y) - F.sum(y) * F.sum(y)
    return points.groupBy("ts_id").agg(rounded(F.try_divide(cov * cov, vx * vy)).alias("linearity"))


def forecast_error(points: DataFrame) -> DataFrame:
    """Spread of what the mean of the three points before leaves."""
    w = _t().rowsBetween(-3, -1)
    e = points.select("ts_id", F.when(F.count("v").over(w) == 3, F.col("v") - F.avg("v").over(w)).alias("e"))
    return e.groupBy("ts_id").agg(rounded(F.stddev_samp("e")).alias("mean3_stderr"))


def motif_entropy(points: DataFrame) -> DataFrame:
    """Entropy of pairs of following letters over the terciles."""
    q = points.groupBy("ts_id").agg(F.percentile("v", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")).withColumnRenamed("ts_id", "q_id")
    letter = (F.col("v") > F.col("q")[0]).cast("int") + (F.col("v") > F.col("q")[1]).cast("int")
    pairs = points.join(q, F.col("ts_id") == F.col("q_id")).select("ts_id", "t", letter.alias("a")).withColumn("b", F.lead("a").over(_t())).filter("b is not null")
    p = pairs.groupBy("ts_id", "a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(_s()))
    return p.groupBy("ts_id").agg(rounded(-F.sum(F.col("p") * F.log("p"))).alias("motif_entropy"))


def mutual_information(points: DataFrame, lag: int = 2, bins: int = 5) -> DataFrame:
    """Between x_t and x_{t+lag}, over equal bins of the range."""
    p = points.withColumn("lo", F.min("v").over(_s())).withColumn("w", (F.max("v").over(_s()) - F.min("v").over(_s())) / bins)
    b = F.coalesce(F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("w"), F.lit(0.0))), F.lit(bins - 1)), F.lit(0))
    pairs = p.select("ts_id", "t", b.alias("a")).withColumn("b", F.lead("a", lag).over(_t())).filter("b is not null")
    joint = pairs.groupBy("ts_id", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy("ts_id", *c))
    parts = joint.select("ts_id", "n", by("a").alias("na"), by("b").alias("nb"), by().alias("all"))
    return parts.groupBy("ts_id").agg(rounded(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb"))))).alias("ami2"))


NUMERIC = ("fund_freq", "freq_mean", "freq_roll_on", "low_fifth_power", "dfa", "rs_range")


def per_series(series: DataFrame, call: Callable[[np.ndarray], dict[str, float]], names: tuple[str, ...]) -> DataFrame:
    """ts_id and the numbers that any callable of one series returns by name: one Arrow call a batch; nan and missing names are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [{"ts_id": ts_id, **call(np.asarray(v, float))} for ts_id, v in zip(part["ts_id"], part["values"])]
            yield pd.DataFrame(rows, columns=["ts_id", *names])

    found = series.select("ts_id", "values").mapInPandas(run, "ts_id long, " + ", ".join(f"{c} double" for c in names))
    return found.select("ts_id", *[rounded(F.col(c)).alias(c) for c in names])


def numeric(series: DataFrame) -> DataFrame:
    """Spectral and fluctuation features."""
    return per_series(series, lambda v: {**K.spectrum_features(v), "dfa": K.fluctuation(v), "rs_range": K.fluctuation(v, True)}, NUMERIC)


def shapes(series: DataFrame) -> DataFrame:
    """Transitions, periodicity, embedding distances, time scales, timing of outliers, change points and seasonality."""
    return per_series(series, shape_kernels.shape_features, shape_kernels.NAMES)


def all_features(series: DataFrame, points: DataFrame) -> DataFrame:
    """All features of every series; each family gives its own columns, and one aggregate by ts_id puts them together, with no join."""
    families = [
        amplitude(series), differences(points), locations(points), levels(points), longest_runs(points), histogram_mode(points, 5), histogram_mode(points, 10),
        acf_features(points), trend(points), forecast_error(points), motif_entropy(points), mutual_information(points), numeric(series), shapes(series),
    ]
    names = [c for f in families for c in f.columns if c != "ts_id"]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)
    return rows.groupBy("ts_id").agg(*[F.max(c).alias(c) for c in names])
