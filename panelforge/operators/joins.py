"""Joins that the DataFrame API has no single call for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def natural(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on all shared column names; refuses frames that share none."""
    keys = [c for c in a.columns if c in set(b.columns)]
    if not keys:
        raise ValueError("no shared columns")
    return a.join(b, keys, how)


def validated(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose right side must have unique keys; a repeated key fails the query when it runs.

    The check is part of the plan (one aggregate over the right side), no job before it.
    """
    checked = b.groupBy(*keys).agg(*[F.first(c).alias(c) for c in b.columns if c not in keys], F.count("*").alias("__n"))
    checked = checked.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("right side has repeated keys")).cast("boolean")).otherwise(True)).drop("__n")
    return a.join(checked, keys, how)


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], payload: list[str], tie: str | None = None) -> DataFrame:
    """Backward as-of join: each left row gets the payload of the last right row of its group at or before its time.

    One exchange by the group, one sort, one pass; ``tie`` orders right rows of
    the same time by its own type (the largest wins, null is the smallest).
    Without a match the payload is null. Null times and null keys match nothing:
    such right rows are left out, such left rows stay with a null payload.
    """
    none = F.lit(None)
    h, side, order, at, last = (f"__{c}" for c in ("held", "side", "tie", "known", "last"))
    held = F.struct(*payload)
    kind = right.select(held.alias("h")).schema["h"].dataType
    tie_kind = right.schema[tie].dataType if tie else "string"
    known = F.lit(True)
    for c in (on, *by):
        known = known & F.col(c).isNotNull()
    lhs = left.select("*", F.lit(1).alias(side), none.cast(tie_kind).alias(order), known.alias(at), none.cast(kind).alias(h))
    rest = [c for c in left.columns if c not in (on, *by)]
    rhs = right.where(known).select(on, *by, *[none.cast(left.schema[c].dataType).alias(c) for c in rest], F.lit(0).alias(side), (F.col(tie) if tie else none.cast(tie_kind)).alias(order), F.lit(True).alias(at), held.alias(h))
    w = Window.partitionBy(*by).orderBy(on, side, F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = lhs.unionByName(rhs).withColumn(last, F.when(F.col(at), F.last(h, ignorenulls=True).over(w))).where(f"{side} = 1")
    return found.select(*left.columns, *[F.col(f"{last}.{c}").alias(c) for c in payload])


def shifted(df: DataFrame, keys: list[str], day: str, value: str, days: int, out: str) -> DataFrame:
    """The inner self-join of each row with the row of its keys ``days`` later, as a range of one window: one exchange, no join.

    A day has one row per key at most; rows without a later one go.
    """
    w = Window.partitionBy(*keys).orderBy(F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))).rangeBetween(days, days)
    return df.withColumn("__there", F.count(F.lit(1)).over(w)).withColumn(out, F.first(value).over(w)).where("__there > 0").drop("__there")


def full_outer_all(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def bridge_sum(y: DataFrame, bridge: DataFrame, key: str, level_keys: list[str], value: str) -> DataFrame:
    """A summing matrix as a join: bottom rows times a (bottom key, group) bridge, summed by group with map-side partial sums."""
    return y.join(bridge, key).groupBy(*level_keys).agg(F.sum(value).alias(value))
