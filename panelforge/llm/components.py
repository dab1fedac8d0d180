"""Connected components of a graph of links, as alternating large-star and small-star steps.

Every node ends with the smallest id that it can reach. Each step joins links
with their nodes' minima, so no neighbour list is collected: a hub's links are
split by Spark's skewed-join handling. Each round is written to the shared
folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import forget, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component of every node with a link to another one (signed order of ids).

    Null ends and loops are no links; repeated and reversed links count once.
    No links: an empty table.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(links.distinct(), "links")
    sign = _sign(now)
    while sign[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = written(low.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "small-star")
        forget(now)
        forget(large)
        now, before, sign = small, sign, _sign(small)
        if sign == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _sign(links: DataFrame) -> tuple:
    """What tells whether a round changed anything: the count and two sums of hashes."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
