"""Scores of point and quantile forecasts, as columns over actual y and forecast f."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rmse(y, f, horizon: int | None = None) -> Column:
    """Root of the mean squared error; with a horizon the sum is divided by it instead of the rows' number."""
    total = F.sum((_c(y) - _c(f)) ** 2)
    return F.sqrt(total / horizon if horizon else total / F.count(_c(y) - _c(f)))


def pinball(y, f, q: float) -> Column:
    """Per-row quantile loss."""
    e = _c(y) - _c(f)
    return F.when(e.isNotNull(), F.greatest(q * e, (q - 1) * e))


def asymmetric_squared(y, f, under: float) -> Column:
    """Squared error, times ``under`` where the forecast is too low."""
    e = _c(y) - _c(f)
    return F.when(e > 0, under * e**2).otherwise(e**2)


def mape(y, f) -> Column:
    """Mean absolute percentage error; rows with actual 0 add 0."""
    return F.avg(F.when(_c(y) == 0, 0.0).otherwise(F.abs(_c(y) - _c(f)) / F.abs(F.nullif(_c(y), F.lit(0.0)))))


def smape(y, f) -> Column:
    size = F.abs(_c(y)) + F.abs(_c(f))
    return F.avg(F.when(size == 0, 0.0).otherwise(2 * F.abs(_c(y) - _c(f)) / F.nullif(size, F.lit(0.0))))


def nd(y, f) -> Column:
    """Sum of absolute errors by sum of absolute actuals."""
    return F.try_divide(F.sum(F.abs(_c(y) - _c(f))), F.sum(F.abs(_c(y))))


def msis(y, lo, hi, scale, alpha: float) -> Column:
    """Mean scaled interval score."""
    y, lo, hi = _c(y), _c(lo), _c(hi)
    wide = hi - lo + 2 / alpha * F.greatest(lo - y, F.lit(0.0)) + 2 / alpha * F.greatest(y - hi, F.lit(0.0))
    return F.try_divide(F.avg(wide), _c(scale))


def weighted_mean(x, w) -> Column:
    return F.try_divide(F.sum(_c(x) * _c(w)), F.sum(F.when(_c(x).isNotNull(), _c(w))))


def sparse_scores(sums: DataFrame, keys: list[str], t: str, q: str, p: str, horizon: int, lag: int, last: int | None = None) -> DataFrame:
    """keys, mse, scale, revenue of each series against its values ``lag`` periods before, over the last ``horizon`` periods.

    ``sums`` has the periods in which a series isn't zero (``t`` a whole number); the rest counts as zero and is never
    made. ``scale`` is the mean squared first difference from the first period to the test: between two neighbours one
    difference, before a gap the value's fall to zero, after it its rise. A value of the test meets the one ``lag`` periods before
    it through a range of the same window; one that nothing follows there is an error of its own. ``revenue`` sums ``p`` over the
    ``horizon`` periods before the test. One exchange and one sort, linear in the rows; ``lag`` is at least the horizon. ``last`` is
    the last period where it is known; without keys all rows are one series.
    """
    if lag < horizon:
        raise ValueError("the forecast would need values of the test")
    w = Window.partitionBy(*keys).orderBy(t)
    at = lambda k: F.sum(q).over(w.rangeBetween(k, k))
    ends = sums.crossJoin(F.broadcast(sums.agg(F.max(t).alias("__hi")))) if last is None else sums.withColumn("__hi", F.lit(last))
    x = ends.select(
        *keys, q, p, F.col(t).alias("__t"), (F.col("__hi") - horizon).alias("__end"),
        F.lag(t).over(w).alias("__prev"), F.lag(q).over(w).alias("__before"), F.lead(t).over(w).alias("__next"),
        at(-lag).alias("__f"), F.count("*").over(w.rangeBetween(lag, lag)).alias("__met"),
    )
    v, first = F.col(q), F.col("__prev").isNull()
    test, joins = F.col("__t") > F.col("__end"), F.col("__prev") == F.col("__t") - 1
    rise = F.when(first, 0.0).when(joins, (v - F.col("__before")) ** 2).otherwise(v**2)
    falls = (F.col("__t") < F.col("__end")) & (F.col("__next").isNull() | (F.col("__next") > F.col("__t") + 1))
    error = F.when(test, (v - F.coalesce("__f", F.lit(0.0))) ** 2).when((F.col("__t") + lag > F.col("__end")) & (F.col("__t") + lag <= F.col("__end") + horizon) & (F.col("__met") == 0), v**2).otherwise(0.0)
    out = x.groupBy(*keys).agg(
        F.sum(error).alias("__e"),
        F.sum(F.when(~test, rise).otherwise(0.0) + F.when(falls, v**2).otherwise(0.0)).alias("__d"),
        (F.max("__end") - F.min("__t")).alias("__n"),
        F.sum(F.when(~test & (F.col("__t") > F.col("__end") - horizon), F.col(p)).otherwise(0.0)).alias("revenue"),
    )
    return out.select(*keys, (F.col("__e") / horizon).alias("mse"), F.when(F.col("__n") > 0, F.col("__d") / F.col("__n")).alias("scale"), "revenue")


def level_totals(scores: DataFrame, level: str = "level") -> DataFrame:
    """level, w, wrmsse, scored: on each level the sum of its series' weights (their shares of its revenue, 0 where there is none), their weighted score and the number of
    series that have one (a scale that isn't null or 0). Sums of products are divided once a level, so series are read once and not kept."""
    rmsse = F.sqrt(F.try_divide("mse", F.nullif("scale", F.lit(0.0))))
    sums = scores.groupBy(level).agg(F.sum("revenue").alias("__all"), F.sum(F.col("revenue") * rmsse).alias("__s"), F.count(rmsse).alias("scored"))
    share = lambda c: F.coalesce(F.try_divide(c, "__all"), F.lit(0.0))
    return sums.select(level, share("__all").alias("w"), F.when(F.col("scored") > 0, share("__s")).alias("wrmsse"), "scored")


def contributions(by_level: DataFrame, level: str, loss: str, weight: str, augmented: int, sampled: int, large: tuple[str, ...], items: str = "item") -> DataFrame:
    """level, loss, weight, share: what each level adds to the whole loss, as if no row had been copied or left out.

    Levels whose name lacks ``items`` have every row ``augmented`` times, so their weight is divided by it; of those in ``large`` one
    row in ``sampled`` was kept, so theirs is multiplied. A row for each level.
    """
    name = F.col(level)
    corrected = F.col(weight) * F.when(name.contains(items), 1.0).otherwise(1.0 / augmented) * F.when(name.isin(*large), float(sampled)).otherwise(1.0)
    each = by_level.select(level, loss, corrected.alias("weight"))
    total = each.agg(F.sum(F.col(loss) * F.col("weight")).alias("__total"))
    return each.crossJoin(F.broadcast(total)).select(level, loss, "weight", F.try_divide(F.col(loss) * F.col("weight"), "__total").alias("share"))
