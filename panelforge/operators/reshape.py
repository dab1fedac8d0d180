"""Reshapes whose columns follow from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A frame has no more columns than this; longer series stay long.
MAX_COLUMNS = 10_000


def unstack(df: DataFrame, keys: list[str], order: str, value: str, prefix: str = "F") -> DataFrame:
    """One row a key with the values by position: F1, F2, ... up to the longest series; shorter ones end in nulls.

    Positions follow ``order``, which should be unique in a key. The number of columns is read from the table first (one number);
    over ``MAX_COLUMNS`` it is a ValueError, no value is dropped. An empty table has the keys alone.
    """
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest > MAX_COLUMNS:
        raise ValueError(f"the longest series has {longest} rows, more than {MAX_COLUMNS} columns")
    placed = df.select(*keys, F.col(value).alias("__v"), F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("__k"))
    if not longest:
        return df.select(*keys).distinct()
    return placed.groupBy(*keys).pivot("__k", list(range(1, longest + 1))).agg(F.first("__v")).select(*keys, *[F.col(str(k)).alias(f"{prefix}{k}") for k in range(1, longest + 1)])
