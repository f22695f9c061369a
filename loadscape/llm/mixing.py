"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source's documents are shuffled by a hash and queued twice (a document may be repeated once). A queued copy's
virtual finish time is the source's cumulative size up to it, divided by the source's target; all copies are then
sorted by that time and taken up to the total budget.

No key is sorted in one task: running sums are taken within buckets of the shuffle hash and added to the sums of
the buckets before, and the cut through the global order is found from the sizes of bins of finish time and then
exactly within the one bin where the budget ends. The number of buckets and bins follows the number of rows.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a copy of size 0 is
taken with its queue place but counts no words; rows that repeat are each mixed, and so are rows with a null id, which shuffles as an empty one; equal finish times go by
source, hash, size and copy; a text of any length counts whole; no rows give no rows; other columns are not read, whatever their names, or
carried along by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadscape.llm.common import kept

WEIGHTS, SHARE, REPEATS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Rows that one task may sort at once.
ROWS = 100_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target from (source, source_size): water filling, one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int") + 1)
    every = Window.orderBy(F.col("fill"), F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    onward = every.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * repeats)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole).cast("double") * share)
        .withColumn("level", level)
        # sources are full in the order of fill; the first that is not sets the level for all after it
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "source", "level"))).over(whole)["level"])
        .select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))
    )


def _hash(seed: str) -> F.Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}")))


def mix(docs: DataFrame, size: F.Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, source, n_taken (copies) and taken (their size) of each row of docs."""
    rows = docs.select("doc_id", "source", size.cast("long").alias("size")).withColumn("order", _hash(seed))
    rows = kept(rows, "mix-sizes")  # the texts are read once
    n = rows.count()
    buckets = max(64, min(65536, 1 << (n // ROWS * 4).bit_length()))
    bucket = F.floor(F.conv(F.substring("order", 1, 4), 16, 10).cast("long") * buckets / 65536).cast("int")
    rows = rows.withColumn("bucket", bucket)

    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, repeats)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        by_bucket.withColumn("start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
        .join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target")
    )
    within = Window.partitionBy("source", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = (
        rows.withColumn("upto", F.sum("size").over(within))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("upto", F.col("upto") + F.col("start"))
    )
    bins = 4 * buckets
    # no copy can be taken at twice its source's target or later
    bin_of = lambda time: F.least(F.floor(time * (bins // 2)), F.lit(bins)).cast("int")
    time = lambda k: F.coalesce((F.col("upto") + k * F.col("source_size")).cast("double") / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0))
    copies = queued.select("doc_id", "source", "order", "size", "source_size", "target", F.posexplode(F.array(*[time(k) for k in range(repeats)])).alias("copy", "time")).withColumn("bin", bin_of(F.col("time")))

    filled = copies.groupBy("bin").agg(F.sum("size").alias("bin_size"))
    up_to_bin = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = per_source.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("budget"))
    # the bin in which the budget ends, and the words taken before it: one row
    cut = (
        filled.withColumn("bin_end", F.sum("bin_size").over(up_to_bin))
        .crossJoin(F.broadcast(budget))
        .filter(F.col("bin_end") > F.col("budget"))
        .agg(F.min(F.struct("bin", F.expr("bin_end - bin_size").alias("before"), "budget")).alias("cut"))
        .select("cut.*")
        .collect()
    )
    at, before, limit = cut[0] if cut else (None, None, None)
    if at is None:
        taken = copies.withColumn("in", F.lit(1))
    else:
        in_order = Window.partitionBy("bin").orderBy("time", F.col("source").asc_nulls_last(), "order", "size", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = copies.filter(F.col("bin") == at).withColumn("in", (F.sum("size").over(in_order) + before <= limit).cast("int"))
        taken = copies.filter(F.col("bin") != at).withColumn("in", (F.col("bin") < at).cast("int")).unionByName(edge)
    return _per_row(taken)


def _per_row(copies: DataFrame) -> DataFrame:
    # rows that repeat share one (doc_id, source, order, size); what was taken of them is dealt back evenly
    some = copies.groupBy("doc_id", "source", "order", "size", "source_size", "target").agg(F.sum("in").alias("n"), F.sum((F.col("copy") == 0).cast("int")).alias("rows"))
    nth = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    each = some.select("*", nth.alias("nth")).withColumn("n_taken", (F.floor(F.col("n") / F.col("rows")) + (F.col("nth") <= F.col("n") % F.col("rows")).cast("long")).cast("long"))
    return each.select("doc_id", "source", "size", "source_size", "target", "n_taken", (F.col("n_taken") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, size: F.Column, **settings) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it."""
    counts = mix(docs, size, **settings).groupBy("doc_id", "source", "size").agg(F.sum("n_taken").alias("n"), F.count(F.lit(1)).alias("rows"))
    # a row travels as one struct, so that no name of its columns can clash with these
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.col("source").alias("row_source"), size.cast("long").alias("row_size"))
    same = F.col("row_id").eqNullSafe(F.col("doc_id")) & F.col("row_source").eqNullSafe(F.col("source")) & (F.col("row_size") == F.col("size"))
    found = whole.join(counts, same).filter("n > 0").select("row", "row_id", "row_source", "row_size", "n", "rows")
    # rows that repeat share what was taken of them
    nth = F.row_number().over(Window.partitionBy("row_id", "row_source", "row_size").orderBy(F.xxhash64(F.to_json("row"))))
    several = found.filter("rows > 1").withColumn("times", (F.floor(F.col("n") / F.col("rows")) + (nth <= F.col("n") % F.col("rows")).cast("int")).cast("int"))
    once = found.filter("rows = 1").withColumn("times", F.col("n").cast("int"))
    return once.unionByName(several).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
