"""Connected components of a table of links, by alternating large and small stars.

Links are pairs of long ids. Every round is two joins on the ids' smallest neighbours, written to the shared
folder; a node with very many links is one key of a sort-merge join whose large partitions adaptive execution
splits, and its smallest neighbour is found by a partial aggregate. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.llm.common import kept


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest of u and its neighbours: the larger ones (large), or u and the smaller ones."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = near.join(lowest, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id of its component) of every id that has a link in (u, v)."""
    links = kept(links.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before or state[0] == 0:
            break
        before = state
        links = kept(_star(_star(links, True), False), "links")
    # now every link goes to the smallest id of its component
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
