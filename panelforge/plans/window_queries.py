"""Queries W1 to W49: windows over the dense brand panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelforge.operators import hierarchy as H
from panelforge.operators import order_statistics as OS
from panelforge.operators import scan as S
from panelforge.operators import windows as W
from panelforge.plans.base import BRAND, SALES, brand_panel, r, sales, t
from panelforge.plans.registry import register
from panelforge.session import checkpoint

def series():
    """The window of one series in the order of days."""
    return W.ordered(["id"], "d")


O = "PARTITION BY id ORDER BY d"  # noqa: E741


def _panel(name: str, columns, oracle: str, fill: bool = True) -> None:
    """A query of id, d and window columns over the panel; ``oracle`` lists the same columns in SQL."""
    source = "panel0" if fill else "panel"

    @register(name, f"WITH {BRAND} SELECT id, d, {oracle} FROM {source}")
    def query(spark, sf_dir):
        return brand_panel(spark, sf_dir, fill).select("id", "d", *columns())


def _roll(sql_agg: str, n: int, shift: int = 0, least: int | None = None, name: str | None = None, digits: int = 6) -> str:
    f = f"({O} ROWS BETWEEN {n + shift - 1} PRECEDING AND {shift} PRECEDING)" if shift else f"({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(y) OVER {f} >= {n if least is None else least} THEN round({sql_agg} OVER {f}, {digits}) END AS {name}"


_panel("w01_lags", lambda: W.lags("y", [28, 29, 35, 42], series()), ", ".join(f"lag(y, {k}) OVER ({O}) AS y_lag_{k}" for k in (28, 29, 35, 42)))
_panel("w02_lag_list", lambda: W.lags("y", list(range(1, 11)), series()), ", ".join(f"lag(y, {k}) OVER ({O}) AS y_lag_{k}" for k in range(1, 11)))
_panel(
    "w03_shift_rolling",
    lambda: [c for n in (7, 30, 180) for c in (r(W.rolling(F.avg, "y", series(), n, 28)).alias(f"mean_{n}"), r(W.rolling(F.stddev_samp, "y", series(), n, 28), 4).alias(f"std_{n}"))],
    ", ".join(f"{_roll('avg(y)', n, 28, name=f'mean_{n}')}, {_roll('stddev_samp(y)', n, 28, name=f'std_{n}', digits=4)}" for n in (7, 30, 180)),
)
_panel("w04_shift_window_grid", lambda: [r(W.rolling(F.avg, "y", series(), n, k)).alias(f"mean_{k}_{n}") for k in (1, 7, 14) for n in (7, 14, 30, 60)], ", ".join(_roll("avg(y)", n, k, name=f"mean_{k}_{n}") for k in (1, 7, 14) for n in (7, 14, 30, 60)))
_panel("w05_rolling_of_lag", lambda: [r(W.rolling(F.avg, "y", series(), n, k)).alias(f"lag_{k}_mean_{n}") for k in (7, 28) for n in (7, 28)], ", ".join(_roll("avg(y)", n, k, name=f"lag_{k}_mean_{n}") for k in (7, 28) for n in (7, 28)))
_panel("w06_min_periods", lambda: [r(W.rolling(F.avg, "y", series(), n, 0, m)).alias(f"mean_{n}") for n, m in ((56, 14), (84, 28))], ", ".join(_roll("avg(y)", n, 0, m, f"mean_{n}") for n, m in ((56, 14), (84, 28))), fill=False)
_panel("w07_rolling_min_max", lambda: [W.rolling(F.min, "y", series(), 7, 1).alias("low"), W.rolling(F.max, "y", series(), 7, 1).alias("high")], f"{_roll('min(y)', 7, 1, name='low')}, {_roll('max(y)', 7, 1, name='high')}")
_panel("w08_rolling_median", lambda: [r(W.rolling(W.quantile(0.5), "y", series(), 15)).alias("median")], _roll("quantile_cont(y, 0.5)", 15, name="median"))
_panel("w09_rolling_quantiles", lambda: [r(q).alias(name) for name, q in W.rolling_quantiles("y", series(), 28, {f"q{int(q * 1000)}": q for q in (0.005, 0.165, 0.5, 0.9)}).items()], ", ".join(_roll(f"quantile_cont(y, {q})", 28, name=f"q{int(q * 1000)}") for q in (0.005, 0.165, 0.5, 0.9)))
_LONG = {180: {"q10_180": 0.1, "median_180": 0.5, "q90_180": 0.9}, 1000: {"median_1000": 0.5, "q90_1000": 0.9}}


@register("w09_long_quantiles", f"WITH {BRAND} SELECT id, d, " + ", ".join(_roll(f"quantile_cont(y, {q})", n, name=name) for n, qs in _LONG.items() for name, q in qs.items()) + " FROM panel0")
def w09_long(spark, sf_dir):
    """Quantiles of frames of 180 and 1,000 days, linear in the rows: one pass with sliding ordered lists."""
    out = OS.rolling_quantiles(brand_panel(spark, sf_dir, True), ["id"], ["d"], "y", _LONG)
    return out.select("id", "d", *[r(name).alias(name) for qs in _LONG.values() for name in qs])


_panel("w10_rolling_std", lambda: [r(W.rolling(F.stddev_samp, "y", series(), 14), 4).alias("std")], _roll("stddev_samp(y)", 14, name="std", digits=4))
_panel("w11_rolling_skew", lambda: [r(F.nanvl(W.rolling_skew("y", series(), 28), F.lit(None)), 4).alias("skew")], f"CASE WHEN count(y) OVER x >= 28 AND stddev_pop(y) OVER x > 0 THEN round(skewness(y) OVER x, 4) END AS skew".replace(" x ", f" ({O} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) ").replace("OVER x,", f"OVER ({O} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW),"))
_panel("w12_rolling_kurt", lambda: [r(F.nanvl(W.rolling_kurt("y", series(), 28), F.lit(None)), 3).alias("kurt")], f"CASE WHEN count(y) OVER x >= 28 AND stddev_pop(y) OVER x > 0 THEN round(kurtosis(y) OVER x, 3) END AS kurt".replace(" x ", f" ({O} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) ").replace("OVER x,", f"OVER ({O} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW),"))
_panel("w13_share_nonzero", lambda: [r(W.rolling(F.avg, F.when(F.col("y") != 0, 1.0).otherwise(0.0), series(), 28)).alias("share")], _roll("avg(CASE WHEN y <> 0 THEN 1.0 ELSE 0.0 END)", 28, name="share"))


def _events_series(spark, sf_dir):
    from panelforge.plans.base import events_daily

    return events_daily(spark, sf_dir)


_EWM = """, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS i FROM ev)
SELECT a.id, a.d, {expr} AS ewm FROM n a JOIN n b ON a.id = b.id AND b.i <= a.i GROUP BY a.id, a.d, a.i"""


@register("w14_ewm_adjusted", "WITH ev AS (SELECT event_type AS id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL)" + _EWM.format(expr="CASE WHEN count(*) >= 4 THEN round(sum(b.n * power(0.7, a.i - b.i)) / sum(power(0.7, a.i - b.i)), 6) END"))
def w14(spark, sf_dir):
    return S.ewm_mean(_events_series(spark, sf_dir), ["id"], ["d"], "n", "e", 0.3, min_periods=4, gaps=False).select("id", "d", r("e").alias("ewm"))


@register("w14_ewm_long", "WITH ev AS (SELECT event_type AS id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL)" + _EWM.format(expr="round(sum(b.n * power(0.7, a.i - b.i)) / sum(power(0.7, a.i - b.i)), 6)"))
def w14_long(spark, sf_dir):
    return S.ewm_mean(_events_series(spark, sf_dir), ["id"], ["d"], "n", "e", 0.3, gaps=False).select("id", "d", r("e").alias("ewm"))


@register("w15_ewm_recursive", "WITH ev AS (SELECT event_type AS id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL)" + _EWM.format(expr="round(sum(b.n * power(5.0::DOUBLE / 7, a.i - b.i) * CASE WHEN b.i = 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / 7 END), 6)"))
def w15(spark, sf_dir):
    return S.ewm_mean(_events_series(spark, sf_dir), ["id"], ["d"], "n", "e", 2 / 7, adjust=False, gaps=False).select("id", "d", r("e").alias("ewm"))


#: Spans of the store x item feature set, with their least numbers of values.
_SPANS = {3: 3, 7: 5, 30: 16}


#: Line items of a task of the item series: what a task holds does not grow with the table.
_ROWS = 500_000


def _item_days(spark, sf_dir):
    """item, d, y: one series for each item over its days with sales, and a null on the day after a sale where the next sale is later still.

    Rows are dealt out once, by item: sums, gaps and a series' means share that exchange. A series has at most a row a day.
    """
    nation = t(spark, sf_dir, "nation").join(F.broadcast(t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey")
    store = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store"), "s_nationkey")
    line = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("store"), F.to_date("l_shipdate").alias("d"), F.col("l_quantity").alias("qty"))
    tasks = max(spark.sparkContext.defaultParallelism, line.count() // _ROWS + 1)  # the count comes from the files' footers
    line = line.where("item IS NOT NULL").join(store, "store").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("item", "d", "qty").repartition(tasks, "item")
    days = line.join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), "item").groupBy("item", "d").agg(F.sum("qty").alias("y"))
    later = F.date_diff(F.lead("d").over(W.ordered(["item"], "d")), "d") > 1
    sale, hole = F.struct("d", "y"), F.struct(F.date_add("d", 1).alias("d"), F.lit(None).cast("double").alias("y"))
    return days.select("item", F.when(later, F.array(sale, hole)).otherwise(F.array(sale)).alias("x")).select("item", F.inline("x"))


_ITEM_DAYS = f"{SALES}, days AS (SELECT item, d, sum(qty) AS y FROM sales GROUP BY ALL), gaps AS (SELECT *, lead(d) OVER (PARTITION BY item ORDER BY d) AS nxt FROM days), it AS (SELECT item, d, y FROM days UNION ALL SELECT item, d + 1, NULL FROM gaps WHERE nxt - d > 1), n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY d) AS i FROM it)"


@register(
    "w14_ewm_spans_with_gaps",
    f"WITH {_ITEM_DAYS}, " + ", ".join(f"e{k} AS (SELECT a.item, a.d, CASE WHEN count(b.y) >= {m} THEN round(sum(b.y * pow({1 - S.ewm_span(k)!r}, a.i - b.i)) / sum(CASE WHEN b.y IS NOT NULL THEN pow({1 - S.ewm_span(k)!r}, a.i - b.i) END), 6) END AS ewm_{k} FROM n a JOIN n b ON a.item = b.item AND b.i <= a.i GROUP BY a.item, a.d, a.i)" for k, m in _SPANS.items())
    + " SELECT item, d, " + ", ".join(f"ewm_{k}" for k in _SPANS) + " FROM " + " JOIN ".join(f"e{k}" + (" USING (item, d)" if n else "") for n, k in enumerate(_SPANS)),
)
def w14_spans(spark, sf_dir):
    """Several spans over the series of every item, with a null after each sale that the next day doesn't follow; all spans ride on one pass."""
    out = _item_days(spark, sf_dir)
    return S.ewm_means(out, ["item"], ["d"], "y", {f"ewm_{k}": (S.ewm_span(k), m) for k, m in _SPANS.items()}, split=False).select("item", "d", *[r(f"ewm_{k}").alias(f"ewm_{k}") for k in _SPANS])


@register(
    "w15_ewm_recursive_with_gaps",
    f"WITH RECURSIVE {_ITEM_DAYS}, walk AS (SELECT item, d, i, CAST(y AS DOUBLE) AS e, 1 AS gap FROM n WHERE i = 1 UNION ALL SELECT n.item, n.d, n.i, "
    "CASE WHEN y IS NULL THEN e WHEN e IS NULL THEN y ELSE (pow(0.7::DOUBLE, gap) * e + 0.3::DOUBLE * y) / (pow(0.7::DOUBLE, gap) + 0.3::DOUBLE) END, CASE WHEN y IS NULL THEN gap + 1 ELSE 1 END FROM walk JOIN n ON n.item = walk.item AND n.i = walk.i + 1) SELECT item, d, round(e, 6) AS ewm FROM walk",
)
def w15_gaps(spark, sf_dir):
    return S.ewm_mean(_item_days(spark, sf_dir), ["item"], ["d"], "y", "e", 0.3, adjust=False, split=False).select("item", "d", r("e").alias("ewm"))


UNTIL = f"({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_panel("w16_expanding_count", lambda: [W.expanding(F.count, "y", series()).alias("n")], f"count(y) OVER {UNTIL} AS n", fill=False)


@register("w17_expanding_volatility", f"WITH {BRAND}, s AS (SELECT id, d, abs(y - lag(y) OVER ({O})) AS a FROM panel0) SELECT id, d, round(avg(a) OVER {UNTIL}, 12) AS vol FROM s")
def w17(spark, sf_dir):
    steps = brand_panel(spark, sf_dir, True).select("id", "d", F.abs(F.col("y") - F.lag("y").over(series())).alias("a"))
    return steps.select("id", "d", r(W.expanding(F.avg, "a", series()), 12).alias("vol"))


_panel("w18_cumulative_mean", lambda: [r(F.try_divide(W.expanding(F.sum, "y", series()), W.expanding(F.count, "y", series()) - 1), 12).alias("scale")], f"round(sum(y) OVER {UNTIL} / nullif(count(y) OVER {UNTIL} - 1, 0), 12) AS scale")
_panel("w19_running_index", lambda: [F.row_number().over(series()).cast("long").alias("i"), W.expanding(F.sum, "y", series()).alias("total")], f"row_number() OVER ({O}) AS i, sum(y) OVER {UNTIL} AS total")
_panel("w20_relative_position", lambda: [r((F.col("y") - W.expanding(F.min, "y", series())) / (1 + W.expanding(F.max, "y", series()) - W.expanding(F.min, "y", series())), 12).alias("rel")], f"round((y - min(y) OVER {UNTIL}) / (1 + max(y) OVER {UNTIL} - min(y) OVER {UNTIL}), 12) AS rel")
_panel("w21_changes", lambda: [(F.col("y") - F.lag("y").over(series())).alias("diff"), r(F.try_divide(F.col("y") - F.lag("y").over(series()), F.lag("y").over(series()))).alias("pct"), r(F.try_divide("y", F.lag("y").over(series()))).alias("ratio")], f"y - lag(y) OVER ({O}) AS diff, round((y - lag(y) OVER ({O})) / nullif(lag(y) OVER ({O}), 0), 6) AS pct, round(y / nullif(lag(y) OVER ({O}), 0), 6) AS ratio")
_panel("w22_group_broadcast", lambda: [F.max("y").over(W.by("id")).alias("hi"), F.min("y").over(W.by("id")).alias("lo"), r(F.stddev_samp("y").over(W.by("id")), 4).alias("std"), r(F.avg("y").over(W.by("id"))).alias("mean"), F.sum("y").over(W.by("id")).alias("total")], "max(y) OVER p AS hi, min(y) OVER p AS lo, round(stddev_samp(y) OVER p, 4) AS std, round(avg(y) OVER p, 6) AS mean, sum(y) OVER p AS total".replace("OVER p", "OVER (PARTITION BY id)"), fill=False)
_panel("w23_distinct_in_group", lambda: [W.distinct_in("y", W.by("id")).alias("n")], "count(DISTINCT y) OVER (PARTITION BY id) AS n", fill=False)
_panel("w24_ratio_to_month_mean", lambda: [r(F.try_divide("y", F.avg("y").over(Window.partitionBy("id", F.year("d"), F.month("d"))))).alias("ratio")], "round(y / nullif(avg(y) OVER (PARTITION BY id, year(d), month(d)), 0), 6) AS ratio")
_panel("w25_ratio_to_max", lambda: [r(F.try_divide("y", F.max("y").over(W.by("id")))).alias("norm"), r(F.try_divide("y", F.avg("y").over(Window.partitionBy("d")))).alias("in_day")], "round(y / nullif(max(y) OVER (PARTITION BY id), 0), 6) AS norm, round(y / nullif(avg(y) OVER (PARTITION BY d), 0), 6) AS in_day")
_CUT = "d <= DATE '2001-06-30'"
_SETS = {H.level_name(level): level for level in H.LEVELS[1:]}


@register(
    "w26_target_encoding",
    f"WITH {SALES} SELECT DISTINCT store, item, "
    + ", ".join(f"round(avg(CASE WHEN {_CUT} THEN qty END) OVER (PARTITION BY {', '.join(k)}), 6) AS {n}_mean, round(stddev_samp(CASE WHEN {_CUT} THEN qty END) OVER (PARTITION BY {', '.join(k)}), 4) AS {n}_std" for n, k in _SETS.items())
    + " FROM sales",
)
def w26(spark, sf_dir):
    """Mean and deviation of the target up to the cut-off under eleven key sets for every item of a store.

    Sets without store and item are worked out on the sums of their three keys and joined; rows are dealt out once by item and once by store, for all sets of each.
    """
    q = F.when(F.expr(_CUT), F.col("qty"))
    sums = [F.count(q).alias("n"), F.sum(q).alias("s"), F.sum(q * q).alias("s2")]
    s = sales(spark, sf_dir).select(*H.DIMENSIONS, "d", "qty")

    def encoded(df, sets):
        columns = []
        for name, keys in sets.items():
            mean, std = W.encoding("n", "s", "s2", W.by(*keys))
            columns += [r(mean).alias(f"{name}_mean"), r(std, 4).alias(f"{name}_std")]
        return df.select("*", *columns)

    of = lambda key: {name: sorted(keys, key=lambda k: k != key) for name, keys in _SETS.items() if key in keys}
    rest = {name: keys for name, keys in _SETS.items() if "store" not in keys and "item" not in keys}
    group = ["region", "cat", "dept"]
    few = encoded(s.groupBy(*group).agg(*sums), rest).select(*[F.col(k).alias(f"__{k}") for k in group], *[f"{name}_{x}" for name in rest for x in ("mean", "std")])
    few = checkpoint(few, "few-keys")  # its size is known to the join
    pairs = encoded(s.repartition("item").groupBy(*H.DIMENSIONS).agg(*sums), of("item"))
    pairs = encoded(pairs.repartition("store"), {name: keys for name, keys in of("store").items() if "item" not in keys})
    out = pairs.join(few, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in group]))
    return out.select("store", "item", *[f"{name}_{x}" for name in _SETS for x in ("mean", "std")])


_panel("w27_encoding_by_weekday", lambda: [r(F.avg(F.when(F.expr(_CUT), F.col("y"))).over(Window.partitionBy("id", F.weekday("d")))).alias("enc_dow"), r(F.avg(F.when(F.expr(_CUT), F.col("y"))).over(Window.partitionBy("id", F.day("d")))).alias("enc_day")], f"round(avg(CASE WHEN {_CUT} THEN y END) OVER (PARTITION BY id, isodow(d)), 6) AS enc_dow, round(avg(CASE WHEN {_CUT} THEN y END) OVER (PARTITION BY id, day(d)), 6) AS enc_day")


@register("w28_encoding_join", f"WITH {BRAND}, e AS (SELECT id, round(avg(y), 6) AS enc FROM panel0 WHERE {_CUT} GROUP BY id) SELECT id, d, y, enc FROM panel0 LEFT JOIN e USING (id)")
def w28(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True)
    return p.join(p.where(_CUT).groupBy("id").agg(r(F.avg("y")).alias("enc")), "id", "left").select("id", "d", "y", "enc")


@register("w29_weekday_rolling", f"WITH {BRAND}, s AS (SELECT *, date_diff('day', DATE '1995-01-01', d) % 7 AS k FROM panel0) SELECT id, d, CASE WHEN count(y) OVER x >= 4 THEN round(avg(y) OVER x, 6) END AS mean_4 FROM s WINDOW x AS (PARTITION BY id, k ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def w29(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True).withColumn("k", F.date_diff("d", F.lit("1995-01-01").cast("date")) % 7)
    return p.select("id", "d", r(W.rolling(F.avg, "y", W.ordered(["id", "k"], "d"), 4)).alias("mean_4"))


_panel("w30_last_days_mean", lambda: [r(W.rolling(F.avg, "y", series(), n)).alias(f"days_{n}") for n in (1, 2, 3, 4)], ", ".join(_roll("avg(y)", n, name=f"days_{n}") for n in (1, 2, 3, 4)))


_WEEK = f"({O} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@register("w31_rolling_trend", f"WITH {BRAND}, s AS (SELECT id, d, CASE WHEN count(y) OVER {_WEEK} >= 7 THEN sum(y) OVER {_WEEK} END AS m FROM panel0) SELECT id, d, round(m / CASE WHEN lag(m, 7) OVER ({O}) = 0 THEN 7 ELSE lag(m, 7) OVER ({O}) END, 10) AS trend FROM s")
def w31(spark, sf_dir):
    """Mean of 7 days by that of the 7 before (0 counts as 1), from sums: the common divisor cancels."""
    s = brand_panel(spark, sf_dir, True).select("id", "d", W.rolling(F.sum, "y", series(), 7).alias("m"))
    past = F.lag("m", 7).over(series())
    return s.select("id", "d", r(F.col("m") / F.when(past == 0, 7.0).otherwise(past), 10).alias("trend"))


@register("w32_days_since_last_sale", f"WITH {BRAND} SELECT id, d, date_diff('day', lag(d) OVER ({O}), d) AS gap FROM daily WHERE y > 0")
def w32(spark, sf_dir):
    p = brand_panel(spark, sf_dir).where("y > 0")
    return p.select("id", "d", F.date_diff("d", F.lag("d").over(series())).cast("long").alias("gap"))


_panel("w33_days_since_nonzero", lambda: [W.days_since_nonzero("y", "d", series()).alias("gap")], f"date_diff('day', last_value(CASE WHEN y <> 0 THEN d END IGNORE NULLS) OVER {UNTIL}, d) AS gap")


def _weekdays_sql(n: int) -> str:
    return "(" + " + ".join(f"lag(y, {7 * k}) OVER ({O})" for k in range(1, n + 1)) + f") / {n}"


_panel("w34_same_weekday_mean", lambda: [r(c).alias(f"m{n}") for n, c in W.same_weekday_means("y", series(), (2, 4, 8)).items()], f"round({_weekdays_sql(2)}, 6) AS m2, round(coalesce({_weekdays_sql(4)}, {_weekdays_sql(2)}), 6) AS m4, round(coalesce({_weekdays_sql(8)}, {_weekdays_sql(4)}, {_weekdays_sql(2)}), 6) AS m8")


@register("w35_first_sale", f"WITH {BRAND} SELECT id, min(CASE WHEN y <> 0 THEN d END) AS first_d FROM panel0 GROUP BY id")
def w35(spark, sf_dir):
    return brand_panel(spark, sf_dir, True).groupBy("id").agg(F.min(F.when(F.col("y") != 0, F.col("d"))).alias("first_d"))


@register("w36_last_sale", f"WITH {BRAND} SELECT id, max(CASE WHEN y > 0 THEN d END) AS last_d FROM panel0 WHERE {_CUT} GROUP BY id")
def w36(spark, sf_dir):
    return brand_panel(spark, sf_dir, True).where(_CUT).groupBy("id").agg(F.max(F.when(F.col("y") > 0, F.col("d"))).alias("last_d"))


_panel("w37_trim_leading_zeros", lambda: [F.when(F.col("d") >= F.min(F.when(F.col("y") != 0, F.col("d"))).over(W.by("id")), F.col("y")).alias("y")], "CASE WHEN d >= min(CASE WHEN y <> 0 THEN d END) OVER (PARTITION BY id) THEN y END AS y")


@register("w38_release_filter", f"WITH {BRAND}, f AS (SELECT id, min(d) AS rel FROM daily GROUP BY id) SELECT id, d, y FROM panel0 JOIN f USING (id) WHERE d >= rel")
def w38(spark, sf_dir):
    p = brand_panel(spark, sf_dir)
    release = p.where("y is not null").groupBy("id").agg(F.min("d").alias("rel"))
    return p.fillna(0.0, ["y"]).join(release, "id").where("d >= rel").select("id", "d", "y")


@register("w39_rolling_revenue_share", f"WITH {BRAND}, s AS (SELECT id, d, {_roll('sum(y)', 28, 0, 1, 'rev')} FROM panel0) SELECT id, d, round(rev / nullif(max(rev) OVER (PARTITION BY d), 0), 6) AS share FROM s")
def w39(spark, sf_dir):
    s = brand_panel(spark, sf_dir, True).select("id", "d", W.rolling(F.sum, "y", series(), 28, 0, 1).alias("rev"))
    return s.select("id", "d", r(F.try_divide("rev", F.max("rev").over(Window.partitionBy("d")))).alias("share"))


@register("w40_nth_flagged_day", f"WITH {BRAND}, s AS (SELECT id, d, CASE WHEN day(d) <= 10 AND day(d) % 2 = 0 THEN 1 ELSE 0 END AS f FROM panel0) SELECT id, d, CAST(sum(f) OVER ({O} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) * f AS BIGINT) AS nth FROM s")
def w40(spark, sf_dir):
    s = brand_panel(spark, sf_dir, True).select("id", "d", F.when((F.day("d") <= 10) & (F.day("d") % 2 == 0), 1).otherwise(0).alias("f"))
    return s.select("id", "d", (F.sum("f").over(W.frame(series(), 15)) * F.col("f")).cast("long").alias("nth"))


_panel("w41_index_in_group", lambda: [(F.weekofyear("d") - F.min(F.weekofyear("d")).over(Window.partitionBy("id", F.year("d"), F.month("d"))) + 1).cast("long").alias("i")], "CAST(week(d) - min(week(d)) OVER (PARTITION BY id, year(d), month(d)) + 1 AS BIGINT) AS i")


@register("w42_event_countdown", f"WITH {BRAND}, e AS (SELECT d, CASE WHEN month(d) = 12 AND day(d) = 25 OR month(d) = 7 AND day(d) = 4 THEN d END AS e FROM (SELECT DISTINCT d FROM panel0)), n AS (SELECT d, min(e) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS nx FROM e) SELECT d, CASE WHEN nx IS NULL THEN 0 ELSE 30 - date_diff('day', d, nx) END AS countdown FROM n")
def w42(spark, sf_dir):
    days = brand_panel(spark, sf_dir).select("d").distinct()
    event = F.when(((F.month("d") == 12) & (F.day("d") == 25)) | ((F.month("d") == 7) & (F.day("d") == 4)), F.col("d"))
    following = Window.partitionBy(F.lit(0)).orderBy("d").rowsBetween(0, 29)  # the calendar: one row a day
    near = days.select("d", F.min(event).over(following).alias("nx"))
    return near.select("d", F.when(F.col("nx").isNull(), 0).otherwise(30 - F.date_diff("nx", "d")).cast("long").alias("countdown"))


@register("w43_shift_event_names", "WITH c AS (SELECT DISTINCT CAST(ts AS DATE) AS d, event_type AS e FROM events), m AS (SELECT d, min(e) AS e FROM c GROUP BY d) SELECT d, lag(e) OVER (ORDER BY d) || '_1' AS after_1, lead(e) OVER (ORDER BY d) || '_m1' AS before_1 FROM m")
def w43(spark, sf_dir):
    m = t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.min("event_type").alias("e"))
    w = Window.partitionBy(F.lit(0)).orderBy("d")
    return m.select("d", F.concat(F.lag("e").over(w), F.lit("_1")).alias("after_1"), F.concat(F.lead("e").over(w), F.lit("_m1")).alias("before_1"))


_panel("w44_rolling_anomaly", lambda: [r(F.col("y") - W.rolling(F.avg, "y", series(), n)).alias(f"anomaly_{n}") for n in (7, 14, 28)], ", ".join(f"round(y - {_roll('avg(y)', n, name='x', digits=12).rsplit(' AS ', 1)[0]}, 6) AS anomaly_{n}" for n in (7, 14, 28)))
_panel("w45_lead_target", lambda: [F.lead("y", 28).over(series()).alias("target")], f"lead(y, 28) OVER ({O}) AS target")
_panel("w46_interpolate", lambda: [F.when((F.month("d") == 12) & (F.day("d") == 25), (F.lag("y").over(series()) + F.lead("y").over(series())) / 2).otherwise(F.col("y")).alias("y")], f"CASE WHEN month(d) = 12 AND day(d) = 25 THEN (lag(y) OVER ({O}) + lead(y) OVER ({O})) / 2 ELSE y END AS y")


@register("w47_supervised_slices", f"WITH {BRAND}, s AS (SELECT id, d, list(y) OVER ({O} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS past, list(y) OVER ({O} ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS future FROM panel0) SELECT id, d, array_to_string(list_transform(past, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS past, array_to_string(list_transform(future, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS future FROM s WHERE len(past) = 14 AND len(future) = 7")
def w47(spark, sf_dir):
    s = brand_panel(spark, sf_dir, True).select("id", "d", F.collect_list("y").over(series().rowsBetween(-13, 0)).alias("past"), F.collect_list("y").over(series().rowsBetween(1, 7)).alias("future"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",").alias(c)
    return s.where("size(past) = 14 and size(future) = 7").select("id", "d", text("past"), text("future"))


@register("w48_average_rank", f"WITH {BRAND}, s AS (SELECT id, round(sum(y) / 1000) AS v FROM panel0 GROUP BY id) SELECT id, v, rank() OVER (ORDER BY v DESC) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rnk FROM s")
def w48(spark, sf_dir):
    s = brand_panel(spark, sf_dir, True).groupBy("id").agg(F.round(F.sum("y") / 1000).alias("v"))
    return s.select("id", "v", W.average_rank_desc("v", Window.partitionBy(F.lit(0))).alias("rnk"))


_BEFORE = f"({O} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)"
_panel("w49_ratio_to_trailing_mean", lambda: [r(F.try_divide(28 * F.col("y"), W.rolling(F.sum, "y", series(), 28, 1)), 10).alias("ratio")], f"CASE WHEN count(y) OVER {_BEFORE} >= 28 THEN round(28 * y / nullif(sum(y) OVER {_BEFORE}, 0), 10) END AS ratio")
