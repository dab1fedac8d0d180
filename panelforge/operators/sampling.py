"""Draws that the hash of a seed and a key decides, so that they repeat on any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def draw_by_weight(df: DataFrame, key: str, weight: str, draws: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """draws (k, u: a number of any size) with the key that each hits: the inverse of the cumulative whole-number weights, with replacement.

    Weights are summed up in the order of (key modulo ``buckets``, key): first
    the buckets' sums, which are few, then each bucket on its own. Null, zero and
    negative weights are never drawn; without any weight there is no row.
    """
    rows = df.select(key, F.col(weight).alias("__w"), F.pmod(F.col(key), F.lit(buckets)).alias("__b")).where("__w > 0")
    sums = rows.groupBy("__b").agg(F.sum("__w").alias("__s"))
    ends = sums.select("__b", "__s", F.sum("__s").over(Window.orderBy("__b")).alias("__hi"), F.sum("__s").over(Window.partitionBy()).alias("__all"))
    hit = draws.crossJoin(F.broadcast(ends)).withColumn("__u", F.pmod("u", "__all")).where("__u >= __hi - __s and __u < __hi")  # bounded: a row a bucket
    within = rows.withColumn("__to", F.sum("__w").over(Window.partitionBy("__b").orderBy(key)))
    wanted = hit.select("k", "u", "__b", (F.col("__u") - F.col("__hi") + F.col("__s")).alias("__at"))
    return wanted.join(within, "__b").where("__at >= __to - __w and __at < __to").select("k", "u", key)
