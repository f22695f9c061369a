"""From a small pool of series to a large one: recipes, their execution, constraints, and the whole pipeline.

Recipes are tables; every draw is a hash of (seed, id, draw number), so a result depends on neither partitioning
nor order. Series are gathered by a join on the source id and computed where they land.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadscape.functions import arrays as A
from loadscape.functions import kernels as K
from loadscape.operators import ordered as O
from loadscape.operators.features import rounded
from loadscape.sources.store import kept

KINDS = ("only_neg", "only_posneg")
CHAIN = "array<struct<tag: string, val: double>>"


def draw(seed: int, ident: str | Column, number: int | Column) -> Column:
    """A number in [0, 1), fixed by its arguments."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(ident) if isinstance(ident, str) else ident, F.lit(number).cast("int")), F.lit(1 << 40)) / float(1 << 40)


def whole(u: Column, low: int, high: int) -> Column:
    """An integer in [low, high) from a draw."""
    return (F.floor(u * (high - low)) + low).cast("int")


# ---- text forms
def parse_chains(lines: DataFrame, col: str = "line") -> DataFrame:
    """src_id and steps of `<id> |> tag:val | tag:val`; the chain may be empty."""
    body = F.split_part(F.col(col), F.lit("|>"), F.lit(2))
    steps = F.filter(F.split(body, r"\|"), lambda x: F.trim(x) != "")
    one = lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("tag"), F.split_part(x, F.lit(":"), F.lit(2)).cast("double").alias("val"))
    return lines.select(F.trim(F.split_part(F.col(col), F.lit("|>"), F.lit(1))).cast("long").alias("src_id"), F.transform(steps, one).cast(CHAIN).alias("steps"))


def chain_line() -> Column:
    """A chain's line, of src_id and steps."""
    steps = F.array_join(F.transform("steps", lambda s: F.concat(s["tag"], F.lit(":"), F.format_string("%.2f", s["val"]))), " | ")
    return F.concat(F.col("src_id").cast("string"), F.lit(" |> "), steps)


def chain_text(chains: DataFrame) -> DataFrame:
    return chains.select(chain_line().alias("line"))


def parse_selections(lines: DataFrame, col: str = "line") -> DataFrame:
    """name, start and stop of `<name> <start> - <stop>`."""
    part = lambda i: F.split_part(F.trim(F.col(col)), F.lit(" "), F.lit(i))
    return lines.select(part(1).alias("name"), part(2).cast("int").alias("start"), part(4).cast("int").alias("stop"))


def selection_text(selections: DataFrame) -> DataFrame:
    return selections.select(F.concat_ws(" ", "name", "start", F.lit("-"), "stop").alias("line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: the trimmed lines of text files that are not empty."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def _listed(i: int) -> Column:
    """The words of the i-th part of `a, b | c, d`."""
    return F.split(F.split_part(F.col("line"), F.lit("|"), F.lit(i)), ",")


def parse_concats(lines: DataFrame) -> DataFrame:
    """out_id, pos, src_id, start, size, points from out_id and line: `ids | starts | stops | new lengths`, each with commas."""
    number = lambda i, k: F.trim(F.get(_listed(i), k)).cast("int")
    one = lambda x, k: F.struct(F.trim(x).cast("long").alias("src_id"), number(2, k).alias("start"), (number(3, k) - number(2, k)).alias("size"), number(4, k).alias("points"))
    return lines.select("out_id", F.posexplode(F.transform(_listed(1), one)).alias("pos", "x")).select("out_id", "pos", "x.*")


def concat_text(recipes: DataFrame) -> DataFrame:
    # at most four sections a series
    parts = recipes.groupBy("out_id").agg(F.array_sort(F.collect_list(F.struct("pos", "src_id", "start", (F.col("start") + F.col("size")).alias("stop"), "points"))).alias("p"))
    return parts.select("out_id", F.concat_ws(" | ", *[F.array_join(F.col("p")[c].cast("array<string>"), ", ") for c in ("src_id", "start", "stop", "points")]).alias("line"))


def parse_superpositions(lines: DataFrame, places: bool = False) -> DataFrame:
    """out_id, src_id, scale from out_id and line: `ids | scales`; with places, also pos, the place in the line."""
    one = lambda x, k: F.struct(*[k.cast("int").alias("pos")] * places, F.trim(x).cast("long").alias("src_id"), F.trim(F.get(_listed(2), k)).cast("double").alias("scale"))
    return lines.select("out_id", F.inline(F.transform(_listed(1), one)))


def superposition_text(recipes: DataFrame) -> DataFrame:
    """out_id and line, in the order of pos where recipes have it, and else of the sources."""
    order = ["pos"] if "pos" in recipes.columns else []
    parts = recipes.groupBy("out_id").agg(F.array_sort(F.collect_list(F.struct(*order, "src_id", "scale"))).alias("p"))
    return parts.select("out_id", F.concat_ws(" | ", *[F.array_join(F.col("p")[c].cast("array<string>"), ", ") for c in ("src_id", "scale")]).alias("line"))


def vary_selections(selections: DataFrame, lengths: DataFrame, copies: int, seed: int = 1) -> DataFrame:
    """Each selection and `copies` - 1 variants of 0.7 to 1.3 times its length elsewhere; lengths: name, n."""
    s = selections.join(lengths, "name").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    key = F.concat_ws("/", "name", "start", "stop")
    size = ((F.col("stop") - F.col("start")) * (0.7 + 0.6 * draw(seed, key, F.col("copy") * 2))).cast("int")
    start = F.floor(draw(seed, key, F.col("copy") * 2 + 1) * F.greatest(F.col("n") - size, F.lit(1))).cast("int")
    moved = s.withColumn("size", size).withColumn("at", start)
    return moved.select("name", F.when(F.col("copy") == 0, F.col("start")).otherwise(F.col("at")).alias("start"), F.when(F.col("copy") == 0, F.col("stop")).otherwise(F.least(F.col("at") + F.col("size"), F.col("n"))).alias("stop"))


def cut_selections(raw: DataFrame, selections: DataFrame, samples: int = 1000, seed: int = 3, change: Callable[[Column], Column] = A.norm_meanmaxabs) -> DataFrame:
    """Series from raw (name, values): the selected slice, nulls and NaN as 0, resampled, and changed: mean removed and scaled, or as an own function of the values says. A constant slice has no shape: a hundred draws take its place."""
    s = raw.join(selections, "name").select(F.xxhash64("name", "start", "stop").alias("ts_id"), F.slice("values", F.col("start") + 1, F.col("stop") - F.col("start")).alias("values"))
    filled = s.withColumn("values", F.transform("values", lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: draw(seed, "ts_id", i))
    lively = filled.withColumn("values", F.when(F.size(F.array_distinct("values")) > 1, F.col("values")).otherwise(drawn))
    return resampled(lively, samples).select("ts_id", change(F.col("values")).alias("values"))


def sections(raw: DataFrame, selections: DataFrame, samples: int = 1000, endpoint: bool = False) -> DataFrame:
    """name, start, stop, t and v: each selected slice with `samples` points, at the places in the raw series that they stand for; to be seen over it."""
    stop = F.col("stop") + int(endpoint)
    cut = raw.join(selections, "name").select(F.xxhash64("name", "start", "stop").alias("ts_id"), "name", "start", stop.alias("stop"), F.slice("values", F.col("start") + 1, stop - F.col("start")).alias("values"))
    fine = resampled(cut, samples).select("ts_id", F.posexplode("values").alias("i", "v"))
    at = F.col("start") + F.col("i") * (F.col("stop") - F.col("start")) / float(max(samples - 1, 1))
    return fine.join(cut.select("ts_id", "name", "start", "stop"), "ts_id").select("name", "start", "stop", at.alias("t"), "v")


# ---- numerical functions of one series
def per_series(series: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """ts_id and f(values), in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"ts_id": part["ts_id"], "values": pd.Series([f(np.asarray(v, float)) for v in part["values"]], dtype=object, index=part.index)})

    return series.select("ts_id", "values").mapInPandas(run, "ts_id long, values array<double>")


def resampled(series: DataFrame, samples: int = 1000) -> DataFrame:
    return per_series(series, lambda v: K.resample(v, samples))


def distorted(series: DataFrame, seed: int) -> DataFrame:
    return per_series(series, lambda v: K.distort_time(v, seed))


def bounds_fixed(series: DataFrame) -> DataFrame:
    return per_series(series, K.fix_bounds)


# ---- chains of signal processors
@dataclass(frozen=True)
class Processor:
    """What a tag does to values by a number, in which range the number is drawn, and how likely the tag is. change is of columns (values, number), or of an array and a number in Arrow."""

    change: Callable
    low: float
    high: float
    probability: float
    arrow: bool = False


#: Tags, ranges and probabilities are fixed values.
PROCESSORS: dict[str, Processor] = {
    "shift": Processor(A.shift, -1.5, 1.5, 0.70),
    "exp": Processor(A.expand, 1.3, 2.0, 0.35),
    "comp": Processor(A.expand, 0.4, 0.8, 0.35),
    "curt_top": Processor(A.curtail_top, 0.03, 0.20, 0.12),
    "curt_bot": Processor(A.curtail_bottom, 0.03, 0.20, 0.12),
    "curt_mid": Processor(A.curtail_middle, 0.03, 0.20, 0.12),
    "dist": Processor(lambda v, x: K.distort_time(v, int(x)), 1.0, 100.0, 0.30, arrow=True),
    "inv": Processor(A.invert, -1.0, -1.0, 0.50),
}


def _folded(steps: Column, processors: dict[str, Processor]) -> Column:
    """values changed by native steps one after another: one expression, however long the chain."""

    def change(v: Column, step: Column) -> Column:
        out = F
        for tag, p in processors.items():
            if not p.arrow:
                out = out.when(step["tag"] == tag, p.change(v, step["val"]))
        unknown = F.raise_error(F.concat(F.lit("no processor "), F.coalesce(step["tag"], F.lit("null")))).cast("array<double>")
        return unknown if out is F else out.otherwise(unknown)

    return F.aggregate(steps, F.col("values"), change)


def apply_chains(df: DataFrame, processors: dict[str, Processor] = PROCESSORS, arrow_steps: int | None = None) -> DataFrame:
    """values changed by the processors in steps, in order.

    Steps in Arrow cut a chain: what is between two of them is one native fold, and they are a stage of their own. arrow_steps: how many of them a chain has
    at most, by default twice the Arrow processors, as chain_recipes() makes it; a chain with more is an error. The plan depends on nothing else.
    """
    arrow = [t for t, p in processors.items() if p.arrow]
    most = 2 * len(arrow) if arrow_steps is None else arrow_steps
    if not most and not arrow:
        return df.withColumn("values", _folded(F.col("steps"), processors))
    columns = df.columns
    cut = F.transform(F.col("steps"), lambda s, i: F.when(s["tag"].isin(arrow), i)) if arrow else F.array().cast("array<int>")
    df = df.withColumn("_cut", F.filter(cut, lambda i: i.isNotNull()))
    more = F.raise_error(F.concat(F.lit(f"more than {most} steps in Arrow: "), F.size("_cut").cast("string"))).cast("array<int>")
    df = df.withColumn("_cut", F.when(F.size("_cut") <= most, F.col("_cut")).otherwise(more))
    for k in range(most + 1):
        start = F.coalesce(F.get("_cut", F.lit(k - 1)) + 1, F.size("steps")) if k else F.lit(0)
        stop = F.coalesce(F.get("_cut", F.lit(k)), F.size("steps"))
        df = df.withColumn("values", _folded(F.slice("steps", start + 1, F.greatest(stop - start, F.lit(0))), processors))
        if k < most:
            df = _in_arrow(df.withColumn("_step", F.get("steps", F.get("_cut", F.lit(k)))), processors)
    return df.select(columns)


def _in_arrow(df: DataFrame, processors: dict[str, Processor]) -> DataFrame:
    """values changed by the one step in Arrow in _step, where there is one."""
    changes = {t: p.change for t, p in processors.items() if p.arrow}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            changed = [v if t is None else changes[t](np.asarray(v, float), x) for v, t, x in zip(part["values"], part["_tag"], part["_number"])]
            yield part.assign(values=pd.Series(changed, dtype=object, index=part.index)).drop(columns=["_tag", "_number"])

    step = df.withColumn("_tag", F.col("_step")["tag"]).withColumn("_number", F.col("_step")["val"]).drop("_step")
    return step.mapInPandas(run, df.drop("_step").schema)


def chain_recipes(series: DataFrame, per_series: int = 8, seed: int = 44, processors: dict[str, Processor] = PROCESSORS) -> DataFrame:
    """out_id, src_id, steps: every processor twice by its probability, values to two digits, in shuffled order; a source's first chain is a small shift down, if there is a shift."""
    base = series.select(F.col("ts_id").alias("src_id"), F.explode(F.sequence(F.lit(0), F.lit(per_series - 1))).alias("nth")).withColumn("key", F.xxhash64("src_id", "nth"))
    picks = []
    for k, (tag, p) in enumerate([*processors.items(), *processors.items()]):
        value = F.round(draw(seed, "key", 3 * k) * (p.high - p.low) + p.low, 2)
        picks.append(F.when(draw(seed, "key", 3 * k + 1) < p.probability, F.struct(draw(seed, "key", 3 * k + 2).alias("o"), F.lit(tag).alias("tag"), value.alias("val"))))
    shuffled = F.array_sort(F.filter(F.array(*picks), lambda x: x.isNotNull()))
    steps = F.transform(shuffled, lambda x: F.struct(x["tag"].alias("tag"), x["val"].alias("val")))
    first = F.array(F.struct(F.lit("shift").alias("tag"), F.round(-(draw(seed, "key", 99) * 0.14 + 0.03), 2).alias("val")))
    start = F.when(F.col("nth") == 0, first).otherwise(steps) if "shift" in processors else steps
    return base.select(F.col("key").alias("out_id"), "src_id", start.cast(CHAIN).alias("steps"))


def modify(series: DataFrame, recipes: DataFrame, processors: dict[str, Processor] = PROCESSORS) -> DataFrame:
    joined = recipes.join(series.withColumnRenamed("ts_id", "src_id"), "src_id")
    return apply_chains(joined.select(F.col("out_id").alias("ts_id"), "values", "steps"), processors).select("ts_id", "values")


# ---- concatenation and superposition
def _numbered(series: DataFrame, buckets: int = 1024) -> DataFrame:
    """ts_id and i, its position in the order of ids: buckets of equal width are numbered each by itself, from the count of those before."""
    ids = series.select("ts_id")
    ends = ids.agg(F.min("ts_id").cast("double").alias("lo"), ((F.max("ts_id").cast("double") - F.min("ts_id").cast("double")) / buckets).alias("w"))
    b = F.coalesce(F.least(F.floor((F.col("ts_id").cast("double") - F.col("lo")) / F.nullif(F.col("w"), F.lit(0.0))), F.lit(buckets - 1)), F.lit(0))
    dealt = ids.crossJoin(F.broadcast(ends)).select("ts_id", b.cast("int").alias("b"))
    # one row a bucket, so the window over them and the broadcast have a fixed size
    sizes = dealt.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("b", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("b").orderBy("ts_id")) - 1
    return dealt.join(F.broadcast(before), "b").select("ts_id", (at + F.col("before")).cast("long").alias("i"))


def concat_recipes(spark: SparkSession, series: DataFrame, n: int = 100, seed: int = 42, length: int = 1000) -> DataFrame:
    """out_id, pos, src_id, start, size, points: two to four sections of 0.2 to 0.5 of the length each."""
    ids = _numbered(series)
    n_in = ids.count()
    r = spark.range(n).select(F.col("id").alias("out_id"), F.explode(F.sequence(F.lit(0), whole(draw(seed, "id", 0), 2, 5) - 1)).alias("pos")).withColumn("key", F.xxhash64("out_id", "pos"))
    part = lambda k: ((draw(seed, "key", k) * 0.3 + 0.2) * length).cast("int")
    r = r.withColumn("i", F.floor(draw(seed, "key", 1) * n_in).cast("long")).withColumn("size", part(2)).withColumn("points", part(3))
    r = r.withColumn("start", F.floor(draw(seed, "key", 4) * (length - F.col("size"))).cast("int"))
    return r.join(ids, "i").select("out_id", "pos", F.col("ts_id").alias("src_id"), "start", "size", "points")


def _join(row: list, overlap: int = 9, samples: int = 1000) -> np.ndarray:
    ramp, out = np.linspace(1 / (overlap + 1), 1 - 1 / (overlap + 1), overlap), None
    for i, p in enumerate(row):
        v = K.resample(np.asarray(p["v"], float), int(p["points"]))
        if i:
            v[:overlap] *= ramp
        if i < len(row) - 1:
            v[-overlap:] *= ramp[::-1]
        out = v if out is None else np.concatenate((out[:-overlap], out[-overlap:] + v[:overlap], v[overlap:]))
    v = K.resample(out, samples)
    v = v - v.mean()
    return v / np.abs(v).max()


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        yield pd.DataFrame({"ts_id": part["out_id"], "values": pd.Series([_join(row) for row in part["parts"]], dtype=object, index=part.index)})


def concatenated(series: DataFrame, recipes: DataFrame) -> DataFrame:
    """Sections resampled, ramped at their joints and joined with overlap; then resampled, mean removed, scaled."""
    cut = recipes.join(series.withColumnRenamed("ts_id", "src_id"), "src_id").select("out_id", "pos", "points", F.slice("values", F.col("start") + 1, F.col("size")).alias("v"))
    # at most four sections a series
    parts = cut.groupBy("out_id").agg(F.array_sort(F.collect_list(F.struct("pos", "points", "v"))).alias("parts"))
    return parts.mapInPandas(_joined, "ts_id long, values array<double>")


def superposition_recipes(spark: SparkSession, sf_dir: str, series: DataFrame) -> DataFrame:
    """A fixed recipe: for the i-th series two to four others at fixed places, scaled by 0.2 to 0.9."""
    ids = _numbered(series)
    n = ids.count()
    r = ids.select(F.col("i").alias("out_id"), F.explode(F.sequence(F.lit(0), (1 + F.col("i") % 3).cast("int"))).alias("k"))
    r = r.select("out_id", ((F.col("out_id") * 7 + F.col("k") * 13 + 5) % n).alias("i"), ((2 + (F.col("out_id") + 3 * F.col("k")) % 8) / 10.0).alias("scale"))
    return r.join(ids, "i").select("out_id", F.col("ts_id").alias("src_id"), "scale")


def random_superpositions(spark: SparkSession, series: DataFrame, n: int, seed: int = 43) -> DataFrame:
    ids = _numbered(series)
    n_in = ids.count()
    r = spark.range(n).select(F.col("id").alias("out_id"), F.explode(F.sequence(F.lit(0), whole(draw(seed, "id", 0), 2, 5) - 1)).alias("pos")).withColumn("key", F.xxhash64("out_id", "pos"))
    r = r.select("out_id", F.floor(draw(seed, "key", 1) * n_in).cast("long").alias("i"), (whole(draw(seed, "key", 2), 2, 10) / 10.0).alias("scale"))
    return r.join(ids, "i").select("out_id", F.col("ts_id").alias("src_id"), "scale")


def superpose(series: DataFrame, recipes: DataFrame) -> DataFrame:
    """Scaled sums of series (two to four each), mean removed, scaled."""
    parts = recipes.join(series.withColumnRenamed("ts_id", "src_id"), "src_id").select("out_id", "src_id", "scale", "values")
    # summed in the order of the sources, so that a result does not depend on arrival
    each = parts.groupBy("out_id").agg(F.array_sort(F.collect_list(F.struct("src_id", "scale", F.transform("values", lambda x: x * F.col("scale")).alias("v")))).alias("p"))
    rest = F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))
    added = F.aggregate(rest, F.col("p")[0]["v"], lambda s, q: F.zip_with(s, q["v"], lambda a, b: a + b))
    return each.select(F.col("out_id").alias("ts_id"), A.norm_meanmaxabs(added).alias("values"))


# ---- constraints, on the long form
def _energies(points: DataFrame) -> DataFrame:
    return O.running(O.running(points, "fwd"), "bwd", falling=True)


def bounds(points: DataFrame) -> DataFrame:
    return _energies(points).groupBy("ts_id").agg((F.max("fwd") <= 0).alias("forward_valid"), (F.max("bwd") <= 0).alias("backward_valid"))


def verified(points: DataFrame, kind: str) -> DataFrame:
    """ts_id of the series that keep every constraint of their kind."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}, not {kind!r}")
    e = _energies(points).groupBy("ts_id").agg(F.avg("v").alias("mean"), F.max(F.abs("v")).alias("peak"), F.max("v").alias("top"), F.max("fwd").alias("fwd"), F.max("bwd").alias("bwd"))
    sign = F.col("top") <= 0 if kind == "only_neg" else F.col("top") > 0
    return e.filter((F.col("mean") < 0) & (F.col("peak") == 1) & sign & (F.col("fwd") <= 0) & (F.col("bwd") <= 0))


def quarter_sine(points: DataFrame, safety: float = 1.001) -> DataFrame:
    """One forward pass: the start lowered by a falling quarter cosine as far as the largest prefix sum asks."""
    c = O.running(points, "c")
    tops = c.groupBy("ts_id").agg(F.max("c").alias("top"), F.min_by("t", F.struct(-F.col("c"), "t")).alias("peak"))
    ramp = F.when(F.col("t") > F.col("peak"), 0.0).when(F.col("peak") == 0, 1.0).otherwise(F.cos(F.lit(np.pi / 2) * F.col("t") / F.nullif(F.col("peak"), F.lit(0))))
    ramped = c.select("ts_id", "t", "v").join(tops, "ts_id").withColumn("ramp", ramp)
    whole_ = ramped.groupBy("ts_id").agg(F.sum("ramp").alias("whole"))
    lowered = F.when(F.col("top") <= 0, F.col("v")).otherwise(F.col("v") - safety * F.col("top") * F.col("ramp") / F.col("whole"))
    return ramped.join(whole_, "ts_id").select("ts_id", "t", rounded(lowered).alias("v"))


def valid_initials(points: DataFrame) -> DataFrame:
    """ts_id of series whose running sum is never above 0 nor below its last value."""
    c = O.running(points, "c").groupBy("ts_id").agg(F.max("c").alias("top"), F.min("c").alias("low"), F.sum("v").alias("total"))
    return c.filter("top <= 0 and low - total >= -1e-9").select("ts_id")


def block_minimum(points: DataFrame, n: int) -> DataFrame:
    """The smallest value in each of n blocks; block edges round half to even."""
    size = F.count(F.lit(1)).over(Window.partitionBy("ts_id"))
    edge = lambda k: F.bround(k * F.col("n") / float(n), 0)
    near = F.floor(F.col("t") * n / F.col("n"))
    # the block by division, moved by one where rounding moved the edge
    guess = points.withColumn("n", size).withColumn("k", near)
    block = F.when(F.col("t") < edge(F.col("k")), F.col("k") - 1).when(F.col("t") >= edge(F.col("k") + 1), F.col("k") + 1).otherwise(F.col("k"))
    return guess.groupBy("ts_id", block.cast("int").alias("t")).agg(rounded(F.min("v")).alias("v"))


def fix_constraints(series: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    """Mean, sign and bounds, in this order."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}, not {kind!r}")
    by = lambda k: 0.01 + 0.09 * draw(seed, "ts_id", k)
    s = series.select("ts_id", A.fix_mean(F.col("values"), 0.01, (by(8), by(9))).alias("values"))
    if kind == "only_neg":
        signed = A.fix_sign_negative(F.col("values"))
    else:
        u = draw(seed, "ts_id", 7)
        # all-negative series move up by a draw between their maximum and their mean
        lift = lambda w: A.let(A.mean(w), lambda m: A.let(F.array_max(w), lambda top: A.let(top + u * (m - top), lambda by: A.norm_maxabs(F.transform(w, lambda x: x - by)))))
        signed = F.when(F.array_max("values") >= 0, F.col("values")).otherwise(lift(F.col("values")))
    return bounds_fixed(s.select("ts_id", signed.alias("values"))).filter(~F.exists("values", F.isnan))


def verify_series(series: DataFrame, kind: str) -> DataFrame:
    """The series that keep every constraint, by expressions on the arrays."""
    v = F.col("values")
    running = lambda x: F.aggregate(x, F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("top")), lambda s, y: F.struct((s["sum"] + y).alias("sum"), F.greatest(s["top"], s["sum"] + y).alias("top")))["top"]
    sign = F.forall(v, lambda x: x <= 0)
    return series.filter((A.mean(v) < 0) & (A.max_abs(v) == 1) & (sign if kind == "only_neg" else ~sign) & (running(v) <= 0) & (running(F.reverse(v)) <= 0))


def manifold(initial: DataFrame, kind: str, seed: int = 42, samples: int = 1000, n_concat: int = 1 << 13, n_superpos: int = 1 << 15, per_series: int = 8, recipes: dict[str, DataFrame] | None = None, processors: dict[str, Processor] = PROCESSORS, keep: bool = False) -> DataFrame:
    """ts_id, kind, values: the initial pool recombined, modified, fixed and verified. New series are named by hashes of what they are made of, so any ids will do.

    recipes receives the tables `concat`, `superpos` and `chains` that the pool is made by; out_id of the last is ts_id of the pool. keep: recipes and series of
    each level are kept as tables.
    """
    spark = initial.sparkSession
    hold = kept if keep else lambda df, _: df
    start = hold(initial.select("ts_id", "values"), "initial")
    named = lambda df, pool: df.withColumn("ts_id", F.xxhash64(F.lit(pool), "ts_id"))
    concat = hold(concat_recipes(spark, start, n_concat, seed), "concat-recipes")
    joined = concatenated(resampled(start, 1000), concat)
    pool = hold(start.unionByName(named(resampled(joined, samples), "concat")), "concatenated")
    superpos = hold(random_superpositions(spark, pool, n_superpos, seed + 1), "superpos-recipes")
    recombined = hold(pool.unionByName(named(superpose(pool, superpos), "superpos")), "superposed")
    chains = hold(chain_recipes(recombined, per_series, seed + 2, processors), "chain-recipes")
    if recipes is not None:
        recipes |= {"concat": concat, "superpos": superpos, "chains": chains}
    return verify_series(fix_constraints(modify(recombined, chains, processors), kind, seed), kind).select("ts_id", F.lit(kind).alias("kind"), "values")


def write_pools(initials: dict[str, DataFrame], path: str, seed: int = 42, step: int = 100, **sizes: int) -> None:
    """Pools of all kinds under path/pool, partitioned by kind, and their recipes as text under path/{table}_{kind}; each kind has seeds of its own.

    Each level's recipes and series are kept before the next is made of them, so what is written as text is what the pool was made by.
    """
    for i, kind in enumerate(k for k in KINDS if k in initials):
        recipes: dict[str, DataFrame] = {}
        manifold(initials[kind], kind, seed + i * step, recipes=recipes, keep=True, **sizes).drop("kind").write.mode("overwrite").parquet(f"{path}/pool/kind={kind}")
        for table, text in (("concat", concat_text), ("superpos", superposition_text), ("chains", chain_text)):
            write_lines(text(recipes[table]), f"{path}/{table}_{kind}")
