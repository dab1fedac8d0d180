"""Window expressions over panels: lags, guarded rolling statistics and expanding ones (exponentially weighted means: scan.py).

Builders return columns, so that a feature set is one ``select``; all that
share keys and order share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def ordered(keys: list[str], order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def lags(c: str, steps: list[int], w: WindowSpec, name: str = "{c}_lag_{k}") -> list[Column]:
    return [F.lag(c, k).over(w).alias(name.format(c=c, k=k)) for k in steps]


def frame(w: WindowSpec, n: int, shift: int = 0) -> WindowSpec:
    """The n rows that end ``shift`` rows before the current one."""
    return w.rowsBetween(-(n + shift - 1), -shift)


def rolling(agg: Callable[[Column], Column], c: Column | str, w: WindowSpec, n: int, shift: int = 0, min_periods: int | None = None) -> Column:
    """An aggregate over the frame, null unless it holds ``min_periods`` (default n) values that aren't null."""
    c, f = (F.col(c) if isinstance(c, str) else c), frame(w, n, shift)
    return F.when(F.count(c).over(f) >= (n if min_periods is None else min_periods), agg(c).over(f))


def quantile(q: float) -> Callable[[Column], Column]:
    """Exact quantile with linear interpolation; takes frames, unlike percentile_cont."""
    return lambda c: F.percentile(c, F.lit(q))


def rolling_quantiles(c: str, w: WindowSpec, n: int, levels: dict[str, float], shift: int = 0) -> dict[str, Column]:
    """Several quantiles of one frame by name: the frame's values are counted once for all of them."""
    all_of = rolling(lambda x: F.percentile(x, F.array(*map(F.lit, levels.values()))), c, w, n, shift)
    return {name: all_of[k] for k, name in enumerate(levels)}


def rolling_skew(c: str, w: WindowSpec, n: int, shift: int = 0) -> Column:
    """Bias-corrected skewness; needs three values."""
    f, k = frame(w, n, shift), F.lit(float(n))
    return F.when(F.count(c).over(f) >= max(n, 3), F.skewness(c).over(f) * F.sqrt(k * (k - 1)) / (k - 2))


def rolling_kurt(c: str, w: WindowSpec, n: int, shift: int = 0) -> Column:
    """Bias-corrected excess kurtosis; needs four values."""
    f, k = frame(w, n, shift), float(n)
    return F.when(F.count(c).over(f) >= max(n, 4), (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * F.kurtosis(c).over(f) + 6))


def expanding(agg: Callable[[Column], Column], c: Column | str, w: WindowSpec) -> Column:
    return agg(F.col(c) if isinstance(c, str) else c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(c: str, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def distinct_in(c: str, w: WindowSpec) -> Column:
    return F.size(F.collect_set(c).over(w)).cast("long")


def days_since_nonzero(c: str, day: str, w: WindowSpec) -> Column:
    """Days since the last non-zero value at or before the row; null before the first."""
    return F.date_diff(F.col(day), F.last(F.when(F.col(c) != 0, F.col(day)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long")


def average_rank_desc(c: str, w: WindowSpec | None = None) -> Column:
    """Descending rank with the average of ties."""
    base = w or Window.partitionBy()
    return F.rank().over(base.orderBy(F.col(c).desc())) + (F.count("*").over((w or Window.partitionBy()).orderBy(F.col(c).desc()).rangeBetween(0, 0)) - 1) / 2


def encoding(n: str, s: str, s2: str, w: WindowSpec) -> tuple[Column, Column]:
    """Mean and sample deviation over a window of counts, sums and sums of squares; null of no value, the deviation of one as well."""
    n, s, s2 = (F.sum(c).over(w) for c in (n, s, s2))
    return F.try_divide(s, n), F.when(n > 1, F.sqrt(F.greatest(F.try_divide(n * s2 - s * s, n * (n - 1)), F.lit(0.0))))


def same_weekday_means(c: str, w: WindowSpec, sizes: tuple[int, ...]) -> dict[int, Column]:
    """Means of the last n same weekdays of a daily series; where one of them lacks, that of the next smaller n."""
    out, smaller = {}, None
    for n in sizes:
        mean = sum((F.lag(c, 7 * k).over(w) for k in range(2, n + 1)), F.lag(c, 7).over(w)) / n
        smaller = out[n] = mean if smaller is None else F.coalesce(mean, smaller)
    return out
