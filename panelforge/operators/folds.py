"""Out-of-fold statistics: for each key and fold, what the key's rows of the other folds say.

Values are counted once, by key, fold and value. Counts subtract, so the exact median of all folds but
one is read off the total's running count less that fold's, in one sorted pass for all folds together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import windows as W

#: Folds are columns of one pass; more of them are refused.
MAX_FOLDS = 100


def out_of_fold(df: DataFrame, keys: list[str], fold: str, value: str, folds: list | None = None) -> DataFrame:
    """keys, fold, n_out, mean_out, median_out: for every fold and every key that has a value in another fold.

    A fold gets rows for keys that it hasn't itself. Null values and rows of a null fold are left out; null keys form a
    group. ``folds`` lists the folds where they are known; else they are read from the table. The median of an even
    number of values is the mean of the middle two. Partial counts meet before the shuffle, so a hot key costs its distinct values.
    """
    df = df.where(F.col(value).isNotNull() & F.col(fold).isNotNull())
    if folds is None:
        folds = sorted(r[0] for r in df.select(fold).distinct().limit(MAX_FOLDS + 1).collect())
    if len(folds) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds")
    counts = df.groupBy(*keys, fold, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    running, all_of = Window.partitionBy(*keys).orderBy("__v"), Window.partitionBy(*keys)
    other = [F.when(F.col(fold) != F.lit(f), F.col("__n")).otherwise(0) for f in folds]
    seen = counts.select(*keys, fold, "__v", "__n", *[F.sum(o).over(running).alias(f"__upto{k}") for k, o in enumerate(other)], *[F.sum(o).over(all_of).alias(f"__all{k}") for k, o in enumerate(other)])
    stats = []
    for k, f in enumerate(folds):
        n, upto = F.col(f"__all{k}"), F.col(f"__upto{k}")
        rank = lambda at: F.min(F.when(upto >= at, F.col("__v")))
        total = F.sum(F.when(F.col(fold) != F.lit(f), F.col("__v") * F.col("__n")))
        stats.append(F.struct(F.lit(f).alias(fold), F.max(n).alias("n_out"), F.try_divide(total, F.max(n)).alias("mean_out"), ((rank(F.floor((n + 1) / 2)) + rank(F.floor(n / 2) + 1)) / 2).alias("median_out")))
    if not stats:
        stats = [F.struct(F.lit(None).cast(df.schema[fold].dataType).alias(fold), F.lit(0).cast("long").alias("n_out"), F.lit(None).cast("double").alias("mean_out"), F.lit(None).cast("double").alias("median_out"))]
    out = seen.groupBy(*keys).agg(F.filter(F.array(*stats), lambda x: x["n_out"] > 0).alias("__s"))
    return out.select(*keys, F.inline("__s"))


def trend_ratios(panel: DataFrame, keys: list[str], day: str, y: str, windows: dict[str, int], target: Column, horizons: range) -> DataFrame:
    """keys, day, horizon, measure, ratio: the target of a day over the trailing means ``horizon`` days before it.

    ``panel`` is dense: every key on every day. ``windows`` names the means and their lengths; a mean of zero
    gives no ratio. Means of all horizons come from one sorted pass over each series; nothing is joined.
    """
    w = W.ordered(keys, day)
    means = panel.select(*keys, day, target.alias("__target"), F.struct(*[F.nullif(W.rolling(F.avg, y, w, n), F.lit(0.0)).alias(name) for name, n in windows.items()]).alias("__m"))
    at = lambda h: (F.lag("__m", h) if h >= 0 else F.lead("__m", -h)).over(w)
    rows = means.select(*keys, day, "__target", F.array(*[F.struct(F.lit(h).alias("horizon"), at(h).alias("m")) for h in horizons]).alias("__h"))
    rows = rows.where("__target is not null").select(*keys, day, "__target", F.inline("__h"))
    long = rows.select(*keys, day, "horizon", "__target", F.inline(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(f"m.{name}").alias("__mean")) for name in windows])))
    return long.where("__mean is not null").select(*keys, day, "horizon", "measure", (F.col("__target") / F.col("__mean")).alias("ratio"))


def nth_weekday_keys(day: Column, horizon: Column) -> list[Column]:
    """from_month, from_day (29 February counts as the 28th), month, weekday (Monday 0) and week of the month (1 to 5) of a day and of the day its forecast is made at."""
    made = F.date_sub(day, horizon)
    leap = (F.month(made) == 2) & (F.day(made) == 29)
    return [F.month(made).alias("from_month"), F.when(leap, 28).otherwise(F.day(made)).alias("from_day"), F.month(day).alias("month"), F.weekday(day).alias("weekday"), F.ceil(F.day(day) / 7).cast("int").alias("month_week")]
