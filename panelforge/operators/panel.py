"""Panels: spines, reshapes, scaffolds and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days_between(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(lo, hi, F.expr("interval 1 day")))


def densify(df: DataFrame, keys: list[str], day: str, values: list[str], fill=None) -> DataFrame:
    """Every key on every day from the first to the last day of the table; missing values null or ``fill``.

    The spine is keys times a sequence inside each row, so nothing but the join is shuffled.
    """
    bounds = df.agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    spine = df.select(*keys).distinct().crossJoin(F.broadcast(bounds)).select(*keys, days_between(F.col("__lo"), F.col("__hi")).alias(day))
    out = spine.join(df.select(*keys, day, *values), [*keys, day], "left")
    return out if fill is None else out.fillna(fill, values)


def future_rows(df: DataFrame, keys: list[str], day: str, horizon: int) -> DataFrame:
    """The keys on the ``horizon`` days after the table's last day."""
    last = df.agg(F.max(day).alias("__hi"))
    return df.select(*keys).distinct().crossJoin(F.broadcast(last)).select(*keys, days_between(F.date_add("__hi", 1), F.date_add("__hi", horizon)).alias(day))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order (ties must be broken by it)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def clip(c: Column, lo=None, hi=None) -> Column:
    """Bounds a value; null stays null."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)
