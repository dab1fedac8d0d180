"""Instances of fixed length from series of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import windows as W


def canonical_instances(
    panel: DataFrame, keys: list[str], day: str, y: str, length: int, features: list[str] | None = None, sample: Column | None = None, future: DataFrame | None = None, tail: int = 0, padding: bool = True, fill: float = 0.0
) -> DataFrame:
    """keys, day (the instance's last), target, observed, features by name, and with a ``tail`` the features of the rows after it.

    Training: an instance ends at each row where ``sample`` is true (null: at every row), and its arrays have the ``length`` rows up to it. Prediction
    (``tail`` over 0): one instance a series, its last ``length`` rows, and the ``tail`` rows of ``future`` (keys, day, features)
    as ``next_<feature>``. Arrays of short series are filled on the left with ``fill``, where ``observed`` is 0 (it is 1 in rows, also where y is
    null; a null y is ``fill``); without ``padding`` such instances are left out. The days of an instance are neighbouring rows of one sort; a frame holds
    ``length`` rows, so no task holds a series. A series with less than ``tail`` future rows has no instance.
    """
    features = features or []
    w = W.ordered(keys, day)
    frame = W.frame(w, length)
    value = {name: F.coalesce(F.col(name).cast("double"), F.lit(fill)) for name in (y, *features)}
    row = F.struct(*[v.alias(name) for name, v in value.items()])
    rows = panel.select(*keys, day, F.collect_list(row).over(frame).alias("__rows"), (F.lead(day).over(w).isNull() if tail else F.lit(True) if sample is None else F.coalesce(sample, F.lit(False))).alias("__ends"))
    rows = rows.where("__ends")
    if not padding:
        rows = rows.where(F.size("__rows") == length)
    lack = length - F.size("__rows")
    padded = lambda xs, x: F.concat(F.array_repeat(F.lit(x), lack.cast("int")), xs)
    out = rows.select(*keys, day, padded(F.col(f"__rows.{y}"), fill).alias("target"), padded(F.transform("__rows", lambda _: F.lit(1)), 0).alias("observed"), *[padded(F.col(f"__rows.{name}"), fill).alias(name) for name in features])
    if not tail:
        return out
    if future is None:
        raise ValueError("a prediction needs the rows after each series")
    ahead = future.select(*keys, day, F.struct(F.col(day), *[v.alias(name) for name, v in value.items() if name != y]).alias("__f"), F.row_number().over(w).alias("__k")).where(F.col("__k") <= tail)
    ahead = ahead.groupBy(*keys).agg(F.array_sort(F.collect_list("__f")).alias("__next")).where(F.size("__next") == tail)  # ``tail`` rows a series
    return out.join(ahead, keys).select(*out.columns, *[F.col(f"__next.{name}").alias(f"next_{name}") for name in features])
