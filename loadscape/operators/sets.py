"""From the features of both kinds to numbered sets: pruning, the reduced space, new ids, and what is joined to sets by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadscape.functions import arrays as A
from loadscape.operators import decluster as D
from loadscape.operators import recombine as R
from loadscape.operators import space as S
from loadscape.operators.recombine import KINDS
from loadscape.sources.series import min_max, to_arrays, to_long
from loadscape.sources.store import Store, kept

#: Features that take no part in a reduced space: discrete or ill-defined dimensions; fixed values.
EXCLUDED = ("stl_peak", "stl_trough", "min", "max", "median_of_signed_diff", "peak2peak", "cross_zero", "fund_freq", "freq_roll_on")

#: What a reduced space has by default: features that stand for the clusters of correlated ones; fixed values.
REPRESENTATIVES = ("temporal_centroid", "loc_of_last_max", "dfa", "rs_range", "mode5", "share_above_mean", "iqr", "mean", "rcp_num", "acf_first_zero", "median_of_abs_diff", "freq_mean", "mean_2nd_diff", "trev")


def pruned(df: DataFrame, columns: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Without the columns; one that is not there is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"not there: {', '.join(missing)}")
    return df.drop(*columns)


def repaired(df: DataFrame, column: str = "dfa", least: float = 0.1) -> DataFrame:
    """Rows whose value is at least `least`, the column scaled to [0, 1] anew; a null value goes with the small ones."""
    return min_max(df.filter(F.col(column) >= least), [column]).select(df.columns)


def reduced_space(df: DataFrame, columns: list[str], choose: list[str] | None = None, exclude: tuple[str, ...] = (), repair: str | None = None) -> DataFrame:
    """Other columns and the chosen features, normalised; without a choice the first feature of each cluster of correlated ones, found only then."""
    return reduction(df, columns, choose, exclude, repair)[0]


def reduction(df: DataFrame, columns: list[str], choose: list[str] | tuple[str, ...] | None = REPRESENTATIVES, exclude: tuple[str, ...] = EXCLUDED, repair: str | None = "dfa", threshold: float = 0.4, with_info: bool = False, **clusters) -> tuple[DataFrame, DataFrame | None]:
    """The space as reduced_space() gives it, with the usual features left out, repaired and chosen; and, where it is needed or asked for, feature, label, pos, inner_corr and outer_corr of all that are not left out."""
    left = [c for c in columns if c not in exclude]
    fspace = S.normalised(pruned(df, exclude), left)
    if repair:
        fspace = repaired(fspace, repair)
    info = None
    if choose is None or with_info:
        matrix, labels = D.hierarchical(fspace, left, threshold, **clusters)
        info = kept(S.cluster_correlations(matrix, labels).join(labels.select("feature", "pos"), "feature"), "clusters")
    if choose is None:
        choose = [r["feature"] for r in S.first_per_cluster(info).orderBy("label").collect()]  # one row a cluster of features
    return fspace.select(*[c for c in fspace.columns if c not in left], *choose), info


def both_kinds(by_kind: dict[str, DataFrame], change: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """change() of each kind's rows, united with their kind; ids of the second kind are moved by OFFSET."""
    out = None
    for i, kind in enumerate(k for k in KINDS if k in by_kind):
        one = change(by_kind[kind]).withColumn("ts_id", F.col("ts_id") + i * D.OFFSET).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def spread(space: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to [0, 1] within each kind; a column that is constant in a kind becomes null there."""
    ends = space.groupBy("kind").agg(*[f(c).alias(f"{c}_{e}") for c in columns for e, f in (("lo", F.min), ("hi", F.max))])  # one row a kind
    scaled = [((F.col(c) - F.col(f"{c}_lo")) / F.nullif(F.col(f"{c}_hi") - F.col(f"{c}_lo"), F.lit(0.0))).alias(c) for c in columns]
    return space.join(F.broadcast(ends), "kind").select(*[c for c in space.columns if c not in columns], *scaled)


def staged_space(store: Store, features: dict[str, DataFrame], columns: list[str], choose: list[str] | tuple[str, ...] = REPRESENTATIVES, **reduced) -> DataFrame:
    """ts_id, kind and the chosen features of both kinds, reduced in one space and spread within each kind: what sets are chosen in. Each step is a stage of the store, so a later run goes on from what is there."""
    kinds = [k for k in KINDS if k in features]
    both = store.stage("both-kinds", lambda *frames, kinds: both_kinds(dict(zip(kinds, frames))), *[features[k] for k in kinds], kinds=kinds)
    space = store.stage("reduced", lambda df, **how: reduction(df, columns, **how)[0], both, choose=list(choose), **reduced)
    return store.stage("spread", lambda df, columns: spread(df, columns).select("ts_id", "kind", *columns), space, columns=sorted(choose))


def mapped_sets(sets: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The chosen sets (set_size, kind, ts_id) under new ids: `info`, which has the old ones, and each table's rows, one for each set that they are in."""
    info = kept(numbered(sets), "set-ids")
    return {"info": info} | {name: remapped(df, info) for name, df in tables.items()}


def numbered(sets: DataFrame) -> DataFrame:
    """set_size, kind, source_id, ts_id: dense new ids in each set and kind in the order of the old ones, those of the second kind from OFFSET. Sets have a fixed size."""
    at = F.row_number().over(Window.partitionBy("set_size", "kind").orderBy("ts_id")) - 1
    return sets.select("set_size", "kind", F.col("ts_id").alias("source_id"), (at + F.when(F.col("kind") == KINDS[1], D.OFFSET).otherwise(0)).cast("long").alias("ts_id"))


def remapped(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of df under their new ids, a row for each set they are in; an id of the mapping that df lacks is an error."""
    rows = mapping.join(df.withColumnRenamed("ts_id", "source_id").drop("kind").withColumn("_here", F.lit(True)), "source_id", "left")
    checked = F.when(F.col("_here"), F.col("ts_id")).otherwise(F.raise_error(F.concat(F.lit("no row of id "), F.col("source_id").cast("string"))).cast("long"))
    return rows.withColumn("ts_id", checked).drop("_here")


def declustered_sets(features: dict[str, DataFrame], columns: list[str], choose: list[str], sizes: tuple[int, ...] = (2048, 512, 128, 32), max_loops: int = 5000, **reduced) -> DataFrame:
    """set_size, kind, source_id, ts_id: both kinds reduced in one space, spread within [0, 1] each, nested sets chosen from each and numbered. sizes count one kind."""
    order, out = sorted(choose), None
    both = spread(reduced_space(both_kinds(features), columns, choose, **reduced), order)
    for kind in KINDS:
        own = both.filter(F.col("kind") == kind).select("ts_id", *order)
        part = D.chain(own, order, sizes, max_loops).withColumn("kind", F.lit(kind)).withColumn("set_size", 2 * F.col("set_size"))
        out = part if out is None else out.unionByName(part)
    return numbered(out)


# ---- what is looked at, cut to length or joined from outside
def picked(df: DataFrame, which: str, n: int, seed: int = 12345) -> DataFrame:
    """n rows from the head (or start), the tail (or end) or at random, by id."""
    if which in ("head", "start"):
        return df.orderBy("ts_id").limit(n)
    if which in ("tail", "end"):
        return df.orderBy(F.col("ts_id").desc()).limit(n)
    if which == "random":
        return D.sample(df, n, seed)
    raise ValueError(f"head, start, tail, end or random, not {which!r}")


def spans(labels: DataFrame, column: str = "label") -> DataFrame:
    """Where each label starts and ends (exclusive) when rows are in the order of labels: a running sum of counts."""
    counts = labels.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # one row a label
    stop = F.sum("n").over(Window.orderBy(column))
    return counts.select(column, (stop - F.col("n")).alias("start"), stop.alias("stop"))


def fitted(series: DataFrame, n: int) -> DataFrame:
    """Every series with n points: interpolated where it has fewer, smallest of blocks where it has more."""
    size = F.size("values")
    more = to_arrays(R.block_minimum(to_long(series.filter(size > n)), n))
    return series.filter(size == n).select("ts_id", "values").unionByName(R.resampled(series.filter(size < n), n)).unionByName(more)


def tiled(series: DataFrame, n: int, repetitions: int = 1) -> DataFrame:
    """Series of n points that repeat the given ones, each fitted to its share of n."""
    one = n // repetitions
    return fitted(series, one).select("ts_id", A.tile(F.col("values"), -(-n // one), n).alias("values"))


def joint_space(pools: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """pool, ts_id and the columns, normalised over all pools together."""
    out = None
    for name, df in pools.items():
        one = df.select(F.lit(name).alias("pool"), "ts_id", *columns)
        out = one if out is None else out.unionByName(one)
    return S.normalised(out, columns)


def plain_names(df: DataFrame) -> DataFrame:
    """Columns named by what stands between their first two double underscores, where there are two."""
    return df.withColumnsRenamed({c: c.split("__")[1] for c in df.columns if c.count("__") > 1})
