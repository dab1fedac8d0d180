"""Scalar expressions: calendar parts, encodings, scalings, distances and kernels."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import checkpoint


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    angle = 2 * math.pi * c / period
    return F.sin(angle), F.cos(angle)


def week_of_month(d: Column) -> dict[str, Column]:
    """Three definitions in use: by ceiling, by floor, and the floor of the day before, clipped to 0..3."""
    day = F.day(d)
    return {"ceil": F.ceil(day / 7), "floor": F.floor(day / 7), "clipped": F.least(F.floor((day - 1) / 7), F.lit(3))}


def dense_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """The distinct rows with ``out``, the place of their value of ``column`` (one row per value; null first) from 0.

    Values are dealt to ranges, which are written with their number; each range
    is numbered on its own and begins where those before it end. Only ranges'
    sizes meet in one place, so the values may be of any number.
    """
    ranges = checkpoint(df.distinct().repartitionByRange(F.col(column).asc_nulls_first()).withColumn("__range", F.spark_partition_id()), "codes")
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__size"))
    begins = sizes.select("__range", (F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).alias("__begin"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(column).asc_nulls_first())) - 1
    return ranges.join(F.broadcast(begins), "__range").withColumn(out, (F.col("__begin") + place).cast("long")).drop("__range", "__begin")


def label_encode(df: DataFrame, column: str, out: str, missing: str = "NA") -> DataFrame:
    """Codes 0.. in the order of the values as text; null counts as ``missing``. The dictionary is a dimension of distinct values."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(missing))
    codes = dense_codes(df.select(key.alias("__k")), "__k", out)
    return df.withColumn("__k", key).join(codes, "__k").drop("__k")


def factorize(df: DataFrame, column: str, order: list[str], out: str) -> DataFrame:
    """Codes 0.. in the order of first appearance under an explicit order; null is -1."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("__first"))
    codes = dense_codes(first, "__first", out).select(column, out)
    return df.join(codes, column, "left").withColumn(out, F.coalesce(out, F.lit(-1).cast("long")))


def normal_quantile(q: float) -> float:
    return NormalDist().inv_cdf(q)


def logit_ratio(q: float, c: float) -> float:
    """Normal distribution function of the scaled logit of a quantile level."""
    return NormalDist().cdf(math.log(q / (1 - q)) * c)


def box_cox(y: Column, lam: float) -> Column:
    return F.log(y) if lam == 0 else (F.pow(y, F.lit(lam)) - 1) / lam


def inverse_box_cox(z: Column, lam: float) -> Column:
    return F.exp(z) if lam == 0 else F.pow(z * lam + 1, F.lit(1 / lam))


def bin_index(c: Column, edges: list[float]) -> Column:
    """The number of edges at or below the value."""
    return sum((F.when(c >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("long")


def rbf(a: Column, b: Column, amplitude: float, scale: float) -> Column:
    return amplitude * F.exp(-((a - b) ** 2) / (2 * scale**2))


def periodic(a: Column, b: Column, amplitude: float, scale: float, period: float) -> Column:
    return amplitude * F.exp(-2 * F.sin(math.pi * F.abs(a - b) / period) ** 2 / scale**2)


def moon_phase(d: Column) -> Column:
    """Eighths of the lunation (0 to 7) since the new moon of 2001-01-01 in the usual approximation."""
    days = F.date_diff(d, F.lit("2001-01-01").cast("date")).cast("double")
    # fixed values: the phase on that day, and lunations a day
    cycles = F.lit(0.20439731) + days * 0.03386319269
    return (F.floor((cycles - F.floor(cycles)) * 8 + 0.5) % 8).cast("long")


def lag_list(season: int, delta: int, n_seasons: int) -> list[int]:
    """Lags around multiples of a season, plus the first seven steps."""
    return sorted({k for k in range(1, 8)} | {s * season + e for s in range(1, n_seasons + 1) for e in range(-delta, delta + 1) if s * season + e > 0})


def yeo_johnson(y: Column, lam: Column) -> Column:
    """The power transform of values of either sign."""
    a, rest = F.abs(y) + 1, 2 - lam
    up = F.when(lam == 0, F.log(a)).otherwise(F.try_divide(F.pow(a, lam) - 1, lam))
    down = F.when(rest == 0, F.log(a)).otherwise(F.try_divide(F.pow(a, rest) - 1, rest))
    return F.when(y >= 0, up).otherwise(-down)


def fit_yeo_johnson(df: DataFrame, column: str, grid: list[float]) -> DataFrame:
    """One row with ``lam``: the exponent of the grid under which the transformed values are likeliest normal (null of an empty table)."""
    y = F.col(column)
    z = df.where(y.isNotNull()).select(y.alias("y"), F.explode(F.array(*map(F.lit, grid))).alias("lam")).select("lam", "y", yeo_johnson(F.col("y"), F.col("lam")).alias("z"))
    facts = z.groupBy("lam").agg(F.count("*").alias("n"), F.var_pop("z").alias("v"), F.sum(F.signum("y") * F.log(F.abs("y") + 1)).alias("j"))
    return facts.agg(F.max_by("lam", (F.col("lam") - 1) * F.col("j") - F.col("n") / 2 * F.log("v")).alias("lam"))


def midpoints(centres: Column) -> Column:
    """The edges between neighbouring bin centres."""
    n = F.size(centres)
    return F.transform(F.arrays_zip(F.slice(centres, F.lit(1), n - 1).alias("a"), F.slice(centres, F.lit(2), n - 1).alias("b")), lambda p: (p["a"] + p["b"]) / 2)


def digitise(y: Column, edges: Column) -> Column:
    """The bin of a value, from 1: one more than the edges at or below it."""
    return (F.size(F.filter(edges, lambda e: e <= y)) + 1).cast("long")


# fixed values: coefficients of the published rational approximation of the normal quantile (relative error below 1.2e-9)
_CENTRE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))
_TAIL_BELOW = 0.02425


def normal_score(u: Column) -> Column:
    """The normal quantile of a level above 0 and below 1, as an expression."""

    def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    def tail(p: Column) -> Column:
        q = F.sqrt(-2 * F.log(p))
        return polynomial(q, _TAIL[0]) / polynomial(q, _TAIL[1])

    q = u - 0.5
    centre = q * polynomial(q * q, _CENTRE[0]) / polynomial(q * q, _CENTRE[1])
    return F.when(u < _TAIL_BELOW, tail(u)).when(u > 1 - _TAIL_BELOW, -tail(1 - u)).otherwise(centre)


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (Monday 0) of a month; n = -1 is its last one."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(first, (weekday - F.weekday(first) + 7) % 7 + 7 * (n - 1))
    last = F.last_day(first)
    return F.date_sub(last, (F.weekday(last) - weekday + 7) % 7)


def observed(day: Column) -> Column:
    """A holiday on Saturday is kept on Friday, one on Sunday on Monday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)
