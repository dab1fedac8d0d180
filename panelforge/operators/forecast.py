"""Baselines, intervals, ensembles and the recursive loop."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import normal_quantile
from panelforge.session import checkpoint


def seasonal_naive(history: DataFrame, key: str, day: str, value: str, season: int, horizon: int) -> DataFrame:
    """key, step, forecast: the last season repeated; series shorter than a season get their mean."""
    w = Window.partitionBy(key).orderBy(F.col(day).desc())
    last = history.select(key, F.col(value).alias("__y"), (F.row_number().over(w) - 1).alias("__back"), F.count("*").over(Window.partitionBy(key)).alias("__n"), F.avg(value).over(Window.partitionBy(key)).alias("__m")).where(F.col("__back") < season)
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    grid = last.select(key, "__n", "__m").distinct().select("*", steps.alias("step"))
    at = grid.withColumn("__back", season - 1 - (F.col("step") - 1) % season)
    return at.join(last.select(key, "__back", "__y"), [key, "__back"], "left").select(key, "step", F.when(F.col("__n") < season, F.col("__m")).otherwise(F.col("__y")).alias("forecast"))


def recursive_mean(history: DataFrame, key: str, day: str, value: str, window: int, horizon: int) -> DataFrame:
    """key, day, forecast: each step is the mean of the last ``window`` values, its own outputs included.

    Only the last ``window`` rows are kept, and each block of seven steps is
    written, so that the plan doesn't grow with the horizon.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col(day).desc()))
    last = history.select(key, day, value).withColumn("__back", back).where(F.col("__back") <= window)
    state = last.groupBy(key).agg(F.max(day).alias("__last"), F.transform(F.sort_array(F.collect_list(F.struct(day, value))), lambda x: x[value]).alias("__xs"))
    out = []
    for step in range(1, horizon + 1):
        mean = F.aggregate("__xs", F.lit(0.0), lambda a, x: a + x) / F.size("__xs")
        state = state.withColumn("__xs", F.concat(F.slice("__xs", 2, window - 1), F.array(mean)))
        if step % 7 == 0:
            state = checkpoint(state, "recursive")
        out.append(state.select(key, F.date_add("__last", step).alias(day), F.element_at("__xs", -1).alias("forecast")))
    return reduce(DataFrame.unionByName, out)


def naive_2(history: DataFrame, key: str, day: str, value: str, season: int, horizon: int) -> DataFrame:
    """Last value, after a multiplicative seasonal decomposition where the series' autocorrelation is seasonal (90 %).

    The test holds twice the squared autocorrelation at the season against
    Bartlett's limit up to and with that lag. Series of fewer than three seasons
    and ones with values that aren't positive have no seasons.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(day)[value].astype(float).to_numpy()
        n, seasonal = len(y), pd.Series(1.0, index=range(season))
        if season > 1 and n >= 3 * season and y.std() > 0 and (y > 0).all():
            z = y - y.mean()
            ac = [float((z[k:] * z[:-k]).sum() / (z * z).sum()) for k in range(1, season + 1)]
            limit = 1.645 * ((1 + 2 * sum(a * a for a in ac)) / n) ** 0.5
            if 2 * ac[-1] ** 2 > limit:
                trend = pd.Series(y).rolling(season, center=True).mean()
                if season % 2 == 0:
                    trend = trend.rolling(2).mean().shift(-1)
                ratio = pd.Series(y) / trend
                seasonal = ratio.groupby(ratio.index % season).mean()
                seasonal = seasonal / seasonal.mean()
        last = y[-1] / seasonal.iloc[(n - 1) % season]
        return pd.DataFrame({key: pdf[key].iloc[0], "step": range(1, horizon + 1), "forecast": [last * seasonal.iloc[(n + k) % season] for k in range(horizon)]})

    kind = history.schema[key].dataType.simpleString()
    return history.select(key, day, value).groupBy(key).applyInPandas(run, f"{key} {kind}, step long, forecast double")


def normal_interval(f: Column, std: Column, q: float) -> Column:
    return f + normal_quantile(q) * std


def nearest_ranks(df: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """keys and the nearest-rank quantiles of each group by name: the least value with at least that share of values up to it.

    Values are sorted and ranked by a window, so a group is never held as one array. Null values don't count; a group of nulls has null quantiles.
    """
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, F.col(value).alias("__v"), F.row_number().over(w.orderBy(F.col(value).asc_nulls_last())).alias("__k"), F.count(value).over(w).alias("__n"))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("__k") >= F.greatest(F.lit(1), F.ceil(q * F.col("__n"))), F.col("__v"))).alias(name) for name, q in levels.items()])


def complete_mean(df: DataFrame, models: list[str], out: str) -> DataFrame:
    """The rows that all models have a forecast for, with their mean instead of them."""
    return df.dropna(subset=models).select(*[c for c in df.columns if c not in models], (sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)).alias(out))


def weighted_blend(weights: dict[str, float]) -> Column:
    """The weighted sum of models; one that has no forecast adds nothing, and a row without any has none."""
    total = sum((F.coalesce(F.col(m) * w, F.lit(0.0)) for m, w in weights.items()), F.lit(0.0))
    return F.when(F.coalesce(*weights).isNotNull(), total)


def kernel_forecast(df: DataFrame, key: str, day: str, value: str, steps: int, age: float, width: float, quantiles: dict[str, float]) -> DataFrame:
    """key, step, expected and weighted quantiles of past values; a value weighs exp(-age) by exp(-distance of its weekday to the step's).

    The age up to a step is a factor that all weights of the step share, so steps
    of one weekday have one forecast. Weights are summed by value and weekday
    before the seven target weekdays are formed. Null values don't weigh.
    """
    last = df.agg(F.max(day).alias("__hi"))
    w = F.exp(-F.date_diff("__hi", day) / age)
    sums = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(last)).groupBy(key, F.col(value).alias("__y"), F.weekday(day).alias("__dow")).agg(F.sum(w).alias("__w"))
    each = sums.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(6)))).groupBy(key, "__k", "__y").agg(F.sum(F.col("__w") * F.exp(-F.abs(F.col("__dow") - F.col("__k")) / width)).alias("__w"))
    group = Window.partitionBy(key, "__k")
    upto = each.select(key, "__k", "__y", "__w", F.sum("__w").over(group.orderBy("__y").rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"), F.sum("__w").over(group).alias("__total"))
    levels = [F.min(F.when(F.col("__upto") >= q * F.col("__total"), F.col("__y"))).alias(name) for name, q in quantiles.items()]
    of_day = upto.groupBy(key, "__k").agg((F.sum(F.col("__w") * F.col("__y")) / F.first("__total")).alias("expected"), *levels)
    ahead = last.select("__hi", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).select("step", F.weekday(F.date_add("__hi", F.col("step"))).alias("__k"))
    return of_day.join(ahead, "__k").select(key, "step", "expected", *quantiles)


def stack_two(df: DataFrame, keys: list[str], y: str, a: str, b: str) -> DataFrame:
    """keys, weight_a, weight_b: least squares of y on two forecasts without an intercept; rows with a null are left out, proportional forecasts have null weights."""
    s = df.dropna(subset=[y, a, b]).groupBy(*keys).agg(*[F.sum(F.col(p) * F.col(q)).alias(n) for n, p, q in (("__aa", a, a), ("__ab", a, b), ("__bb", b, b), ("__ya", y, a), ("__yb", y, b))])
    aa, ab, bb, ya, yb = (F.col(c) for c in ("__aa", "__ab", "__bb", "__ya", "__yb"))
    det = aa * bb - ab * ab
    return s.select(*keys, F.try_divide(bb * ya - ab * yb, det).alias("weight_a"), F.try_divide(aa * yb - ab * ya, det).alias("weight_b"))
