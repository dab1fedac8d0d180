"""Queries H, B, Q and E: hierarchy and reconciliation, baselines, quantiles and ensembles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import distributions as D
from panelforge.functions.scalars import logit_ratio, normal_quantile
from panelforge.operators import folds
from panelforge.operators import forecast as B
from panelforge.operators import hierarchy as H
from panelforge.operators import joins as J
from panelforge.operators import metrics as M
from panelforge.operators import panel
from panelforge.operators import regression as R
from panelforge.operators import windows as W
from panelforge.plans.base import BRAND, EVENTS, SALES, brand_panel, events_daily, levels_sql, r, sales, t
from panelforge.plans.registry import register
from panelforge.plans.window_queries import series
from panelforge.session import checkpoint

O = "PARTITION BY id ORDER BY d"  # noqa: E741
#: Actuals and a forecast by the value four weeks before, over the last year.
FC = f"{BRAND}, fc AS (SELECT id, d, y, f FROM (SELECT id, d, y, lag(y, 28) OVER ({O}) AS f FROM panel0) WHERE d >= DATE '2001-01-01')"


def forecasts(spark, sf_dir, lag: int = 28):
    p = brand_panel(spark, sf_dir, True).select("id", "d", "y", F.lag("y", lag).over(series()).alias("f"))
    return p.where("d >= '2001-01-01'")


@register("h01_bottom_up", f"WITH {SALES}, s AS (SELECT region, store, cat, dept, item, qty FROM sales) {levels_sql('sum(qty) AS q')}")
def h01(spark, sf_dir):
    return H.rollup(sales(spark, sf_dir), H.LEVELS, [], {"q": F.col("qty")})


#: The cascade's levels from the top to the bottom, by the keys that each adds; every level's forecast is its own sum in whole tens.
_CASCADE = ([], ["region"], ["store"], ["cat"], ["dept"], ["item"])


def _cascade_sql() -> str:
    keys, parts = [], [f"WITH {SALES}", "a0 AS (SELECT year(d) AS yr, ceil(sum(qty) / 10) * 10 * 1.1 AS q FROM sales GROUP BY 1)"]
    for k, added in enumerate(_CASCADE[1:], 1):
        parent, keys = ["yr", *keys], [*keys, *added]
        parts.append(f"v{k} AS (SELECT {', '.join(keys)}, year(d) AS yr, ceil(sum(qty) / 10) * 10 AS q FROM sales GROUP BY ALL)")
        parts.append(f"a{k} AS (SELECT {', '.join(keys)}, yr, v.q * a.q / sum(v.q) OVER (PARTITION BY {', '.join(parent)}) AS q FROM v{k} v JOIN a{k - 1} a USING ({', '.join(parent)}))")
    return ", ".join(parts) + f" SELECT store, item, yr, round(q, 5) AS adjusted FROM a{len(_CASCADE) - 1}"


@register("h02_top_down_cascade", _cascade_sql())
def h02(spark, sf_dir):
    bottom = checkpoint(sales(spark, sf_dir).groupBy(*H.DIMENSIONS, F.year("d").cast("long").alias("yr")).agg(F.sum("qty").alias("qty")), "cascade")
    tens = lambda c: F.ceil(c / 10) * 10.0
    level = lambda *keys: bottom.groupBy(*keys, "yr").agg(tens(F.sum("qty")).alias("qty"))
    stores = H.cascade(level().select("yr", (F.col("qty") * 1.1).alias("qty")), [(level("region"), []), (level("region", "store"), ["region"])], "yr", "qty")
    return H.cascade_within(bottom, stores, ["store", "yr", "region"], ["cat", "dept", "item"], "qty", tens).select("store", "item", "yr", r("adjusted", 5).alias("adjusted"))


@register("h03_trailing_share", f"WITH {BRAND}, x AS (SELECT id, avg(y) AS m FROM panel0, bounds WHERE d > hi - 28 GROUP BY id) SELECT id, round(m / sum(m) OVER (), 6) AS share FROM x")
def h03(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True)
    m = p.crossJoin(F.broadcast(p.agg(F.max("d").alias("hi")))).where("d > date_sub(hi, 28)").groupBy("id").agg(F.avg("y").alias("m"))
    return m.crossJoin(m.agg(F.sum("m").alias("s"))).select("id", r(F.col("m") / F.col("s")).alias("share"))


@register("h04_calibration", f"WITH {FC}, k AS (SELECT id, avg(y) / nullif(avg(f), 0) AS k FROM fc WHERE d < DATE '2001-06-01' GROUP BY id) SELECT id, d, round(f * k, 6) AS f FROM fc JOIN k USING (id) WHERE d >= DATE '2001-06-01'")
def h04(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    k = f.where("d < '2001-06-01'").groupBy("id").agg(F.try_divide(F.avg("y"), F.avg("f")).alias("k"))
    return f.where("d >= '2001-06-01'").join(k, "id").select("id", "d", r(F.col("f") * F.col("k")).alias("f"))


_TOP = "tp AS (SELECT d, y, lag(y, 35) OVER (ORDER BY d) AS top, lag(y) OVER (ORDER BY d) AS before FROM (SELECT d, sum(y) AS y FROM panel0 GROUP BY d))"


@register("h05_alignment_errors", f"WITH {FC}, {_TOP}, b AS (SELECT d, sum(f) AS s FROM fc GROUP BY d), sc AS (SELECT avg(pow(y - before, 2)) AS scale FROM tp WHERE d < DATE '2001-01-01') SELECT round(avg(s - top), 6) AS bias, round(avg(abs(s - top)), 6) AS mae, round(sqrt(avg(pow(s - top, 2))), 6) AS rmse, round(sqrt(avg(pow(s - top, 2)) / (SELECT scale FROM sc)), 6) AS rmsse FROM b JOIN tp USING (d)")
def h05(spark, sf_dir):
    """How far the summed bottom forecasts are from the total's own forecast (its value five weeks before)."""
    days = brand_panel(spark, sf_dir, True).groupBy("d").agg(F.sum("y").alias("y"))
    moved = days.select(F.date_add("d", 35).alias("d"), F.col("y").alias("top"))
    before = days.select(F.date_add("d", 1).alias("d"), F.col("y").alias("before"))
    scale = days.join(before, "d").where("d < '2001-01-01'").agg(F.avg((F.col("y") - F.col("before")) ** 2).alias("scale"))
    x = forecasts(spark, sf_dir).groupBy("d").agg(F.sum("f").alias("s")).join(moved, "d")
    e = F.col("s") - F.col("top")
    out = x.agg(F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse")).crossJoin(scale)
    return out.select(r("bias").alias("bias"), r("mae").alias("mae"), r(F.sqrt("mse")).alias("rmse"), r(F.sqrt(F.col("mse") / F.col("scale"))).alias("rmsse"))


@register("h06_parent_features", f"WITH {BRAND}, a AS (SELECT d, avg(y) AS m FROM panel0 GROUP BY d) SELECT id, d, y, round(avg(m) OVER ({O} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS parent_7 FROM panel0 JOIN a USING (d)")
def h06(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True)
    parent = p.groupBy("d").agg(F.avg("y").alias("m"))
    return p.join(parent, "d").select("id", "d", "y", r(F.avg("m").over(W.frame(series(), 7))).alias("parent_7"))


@register("h07_out_of_fold_year", f"WITH {BRAND} SELECT id, yr, round((sum(s) OVER (PARTITION BY id) - s) / nullif(sum(n) OVER (PARTITION BY id) - n, 0), 6) AS mean_out FROM (SELECT id, year(d) AS yr, sum(y) AS s, count(y) AS n FROM panel0 GROUP BY ALL)")
def h07(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True).withColumn("yr", F.year("d").cast("long"))
    return H.leave_one_out(p, ["id"], "yr", "y").select("id", "yr", r("mean_out").alias("mean_out"))


@register("h08_out_of_fold_weekday", f"WITH {BRAND}, e AS (SELECT id, isodow(d) - 1 AS dow, (day(d) - 1) // 7 AS nth, year(d) AS yr, sum(y) AS s, count(y) AS n FROM panel0 GROUP BY ALL) SELECT id, dow, nth, yr, round((sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0), 6) AS mean_out FROM e WINDOW w AS (PARTITION BY id, dow, nth)")
def h08(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True).select("id", "y", F.weekday("d").cast("long").alias("dow"), F.floor((F.day("d") - 1) / 7).alias("nth"), F.year("d").cast("long").alias("yr"))
    return H.leave_one_out(p, ["id", "dow", "nth"], "yr", "y").select("id", "dow", "nth", "yr", r("mean_out").alias("mean_out"))


def _group_days(spark, sf_dir, levels):
    """level, group_id, d, y on every day."""
    sums = H.rollup(sales(spark, sf_dir).select(*H.DIMENSIONS, "d", "qty"), levels, ["d"], {"y": F.col("qty")})
    return panel.densify(sums, ["level", "group_id"], "d", ["y"], 0.0)


_GROUP_DAYS = f"""{SALES}, gd AS (SELECT 'total' AS level, 'Total_X' AS group_id, d, sum(qty) AS y FROM sales GROUP BY d UNION ALL SELECT 'region', region || '_X', d, sum(qty) FROM sales GROUP BY region, d),
span AS (SELECT level, group_id, CAST(unnest(generate_series((SELECT min(d) FROM gd)::TIMESTAMP, (SELECT max(d) FROM gd)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT level, group_id FROM gd)),
dense AS (SELECT level, group_id, d, coalesce(y, 0.0) AS y FROM span LEFT JOIN gd USING (level, group_id, d)),
m AS (SELECT *, """ + ", ".join(f"CASE WHEN count(*) OVER w{n} >= {n} THEN avg(y) OVER w{n} END AS m{n}" for n in (7, 28)) + " FROM dense WINDOW " + ", ".join(f"w{n} AS (PARTITION BY level, group_id ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (7, 28)) + ")"


def _out_sql(keys: str) -> str:
    return f" SELECT {keys}, f.yr, count(*) AS n_out, round(avg(ratio), 6) AS mean_out, round(median(ratio), 6) AS median_out FROM x JOIN (SELECT DISTINCT yr FROM x) f ON x.yr <> f.yr GROUP BY ALL"


@register(
    "h07_day_of_year_trend",
    f"WITH {_GROUP_DAYS}, b AS (SELECT level, group_id, d AS made, {{'measure': 'mean_28', 'v': m28}} AS v FROM m), "
    "x AS (SELECT t.level, t.group_id, v.measure AS measure, h AS horizon, dayofyear(t.d) AS doy, year(t.d) AS yr, t.target / v.v AS ratio FROM (SELECT level, group_id, d, lag(m7, 4) OVER (PARTITION BY level, group_id ORDER BY d) AS target FROM m) t, range(1, 29) g(h), b WHERE b.level = t.level AND b.group_id = t.group_id AND b.made = t.d - CAST(h AS INTEGER) AND t.target IS NOT NULL AND v.v > 0)"
    + _out_sql("level, group_id, measure, doy, horizon"),
)
def h07_day_of_year(spark, sf_dir):
    """How the week around a day of the year compares with the means known 1 to 28 days before it, in all other years: mean and exact median."""
    p = _group_days(spark, sf_dir, [[], ["region"]])
    p = p.withColumn("m7", W.rolling(F.avg, "y", W.ordered(["level", "group_id"], "d"), 7))
    target = F.lag("m7", 4).over(W.ordered(["level", "group_id"], "d"))
    x = folds.trend_ratios(p, ["level", "group_id"], "d", "y", {"mean_28": 28}, target, range(1, 29))
    x = x.select("level", "group_id", "measure", F.dayofyear("d").cast("long").alias("doy"), F.col("horizon").cast("long").alias("horizon"), F.year("d").cast("long").alias("yr"), "ratio")
    out = folds.out_of_fold(x, ["level", "group_id", "measure", "doy", "horizon"], "yr", "ratio")
    return out.withColumns({c: r(c) for c in ("mean_out", "median_out")})


@register(
    "h08_nth_weekday_trend",
    f"WITH {_GROUP_DAYS}, k AS (SELECT t.level, t.group_id, t.d, b.d AS made, t.y / b.m28 AS ratio FROM m t, range(-2, 32) g(h), m b WHERE t.level = 'total' AND b.level = t.level AND b.group_id = t.group_id AND b.d = t.d - CAST(h AS INTEGER) AND b.m28 > 0), "
    "x AS (SELECT level, group_id, month(made) AS from_month, CASE WHEN month(made) = 2 AND day(made) = 29 THEN 28 ELSE day(made) END AS from_day, month(d) AS month, isodow(d) - 1 AS weekday, CAST(ceil(day(d) / 7) AS BIGINT) AS month_week, year(d) AS yr, ratio FROM k)"
    + _out_sql("level, group_id, from_month, from_day, month, weekday, month_week"),
)
def h08_nth_weekday(spark, sf_dir):
    """The ratio of a day's units to the monthly mean at the day its forecast was made, by that day of the year and the day's weekday of the month, in all other years."""
    p = _group_days(spark, sf_dir, [[]])
    x = folds.trend_ratios(p, ["level", "group_id"], "d", "y", {"mean_28": 28}, F.col("y"), range(-2, 32))
    keys = folds.nth_weekday_keys(F.col("d"), F.col("horizon"))
    names = ["from_month", "from_day", "month", "weekday", "month_week"]
    x = x.select("level", "group_id", *keys, F.year("d").cast("long").alias("yr"), "ratio").withColumns({c: F.col(c).cast("long") for c in names})
    out = folds.out_of_fold(x, ["level", "group_id", *names], "yr", "ratio")
    return out.withColumns({c: r(c) for c in ("mean_out", "median_out")})


@register("h09_event_effect", f"WITH {BRAND}, e AS (SELECT id, d, year(d) AS yr, y / nullif(avg(y) OVER (PARTITION BY id, year(d)), 0) AS x FROM panel0), x AS (SELECT id, yr, sum(x) AS s, count(x) AS n FROM e WHERE month(d) = 12 AND day(d) BETWEEN 20 AND 26 GROUP BY ALL) SELECT id, yr, round((sum(s) OVER (PARTITION BY id) - s) / nullif(sum(n) OVER (PARTITION BY id) - n, 0), 6) AS effect FROM x")
def h09(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True).withColumn("yr", F.year("d").cast("long"))
    e = p.withColumn("x", F.try_divide("y", F.avg("y").over(W.by("id", "yr")))).where((F.month("d") == 12) & F.day("d").between(20, 26))
    return H.leave_one_out(e, ["id"], "yr", "x").select("id", "yr", r("mean_out").alias("effect"))


@register("h10_detrend", f"WITH {BRAND}, s AS (SELECT id, d, y, max(y) OVER (PARTITION BY id) - avg(y) OVER ({O} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS k FROM panel0) SELECT id, d, round(y + k, 6) AS lifted, y AS back FROM s")
def h10(spark, sf_dir):
    k = F.max("y").over(W.by("id")) - F.avg("y").over(W.frame(series(), 28))
    s = brand_panel(spark, sf_dir, True).select("id", "d", "y", k.alias("k"), (F.col("y") + k).alias("l"))
    return s.select("id", "d", r("l").alias("lifted"), r(F.col("l") - F.col("k")).alias("back"))


@register("h11_residual_target", f"WITH {BRAND} SELECT id, d, round(y - avg(y) OVER ({O} ROWS BETWEEN 392 PRECEDING AND 28 PRECEDING), 6) AS res FROM panel0 QUALIFY row_number() OVER ({O}) > 392")
def h11(spark, sf_dir):
    s = brand_panel(spark, sf_dir, True).select("id", "d", (F.col("y") - W.rolling(F.avg, "y", series(), 365, 28)).alias("res"))
    return s.where("res is not null").select("id", "d", r("res").alias("res"))


@register("b01_seasonal_naive", f"WITH {BRAND}, l AS (SELECT id, y, row_number() OVER (PARTITION BY id ORDER BY d DESC) - 1 AS back FROM panel0 QUALIFY back < 7) SELECT id, CAST(k AS INTEGER) AS step, y AS forecast FROM l JOIN range(1, 29) s(k) ON back = 6 - (k - 1) % 7")
def b01(spark, sf_dir):
    return B.seasonal_naive(brand_panel(spark, sf_dir, True), "id", "d", "y", 7, 28)


@register("b02_naive_2")
def b02(spark, sf_dir):
    return B.naive_2(brand_panel(spark, sf_dir, True).select("id", "d", (F.col("y") + 1).alias("y")), "id", "d", "y", 7, 28)


@register("b03_trivial", f"WITH {BRAND} SELECT id, round(avg(y), 6) AS mean_28, 0.0::DOUBLE AS constant, arg_max(y, d) AS identity FROM panel0, bounds WHERE d > hi - 28 GROUP BY id")
def b03(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True)
    last = p.crossJoin(F.broadcast(p.agg(F.max("d").alias("hi")))).where("d > date_sub(hi, 28)")
    return last.groupBy("id").agg(r(F.avg("y")).alias("mean_28"), F.lit(0.0).alias("constant"), F.max_by("y", "d").alias("identity"))


@register(
    "b04_kernel_sampler",
    f"""WITH {BRAND}, w AS (SELECT id, y, isodow(d) - 1 AS dow, exp(-date_diff('day', d, hi) / 28.0::DOUBLE) AS w FROM panel0, bounds), x AS (SELECT id, k, y, sum(w * exp(-abs(dow - k) / 2.0::DOUBLE)) AS w FROM w, range(7) g(k) GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY id, k ORDER BY y) AS upto, sum(w) OVER (PARTITION BY id, k) AS total FROM x), e AS (SELECT id, k, sum(w * y) / any_value(total) AS expected, min(CASE WHEN upto >= 0.1::DOUBLE * total THEN y END) AS q10, min(CASE WHEN upto >= 0.5::DOUBLE * total THEN y END) AS q50, min(CASE WHEN upto >= 0.9::DOUBLE * total THEN y END) AS q90 FROM c GROUP BY id, k)
SELECT id, CAST(s AS INTEGER) AS step, round(expected, 6) AS expected, q10, q50, q90 FROM e JOIN (SELECT s, isodow(CAST(hi + CAST(s AS INTEGER) AS DATE)) - 1 AS k FROM bounds, range(1, 29) g(s)) USING (k)""",
)
def b04(spark, sf_dir):
    """What sampling past values by the kernel of their age and weekday converges to: expectation and quantiles of each step."""
    f = B.kernel_forecast(brand_panel(spark, sf_dir, True), "id", "d", "y", 28, 28.0, 2.0, {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return f.select("id", "step", r("expected").alias("expected"), "q10", "q50", "q90")


def recursive_sql(window: int) -> str:
    """The recursion over the last ``window`` values: id, k (the step), hi (the last day), xs."""
    return f"""WITH RECURSIVE {BRAND}, l AS (SELECT id, list(y ORDER BY d) AS xs, max(d) AS hi FROM panel0, bounds WHERE d > bounds.hi - {window} GROUP BY id),
rec AS (SELECT id, hi, xs, 0 AS k FROM l UNION ALL SELECT id, hi, list_append(xs[2:], list_sum(xs) / len(xs)), k + 1 FROM rec WHERE k < 28)"""


@register("b05_recursive", recursive_sql(7) + " SELECT id, CAST(hi + k AS DATE) AS d, round(xs[-1], 6) AS forecast FROM rec WHERE k > 0")
def b05(spark, sf_dir):
    return B.recursive_mean(brand_panel(spark, sf_dir, True), "id", "d", "y", 7, 28).select("id", "d", r("forecast").alias("forecast"))


@register("b06_direct_per_week", f"WITH {BRAND} SELECT id, h, round(avg(y), 6) AS f FROM panel0, bounds, (VALUES (7), (14), (21), (28)) v(h) WHERE d > hi - h GROUP BY ALL")
def b06(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True)
    last = p.crossJoin(F.broadcast(p.agg(F.max("d").alias("hi")))).where("d > date_sub(hi, 28)")
    return last.select("id", "d", "y", "hi", F.explode(F.array(*map(F.lit, (7, 14, 21, 28)))).alias("h")).where("d > date_sub(hi, h)").groupBy("id", "h").agg(r(F.avg("y")).alias("f"))


_H = range(1, 29)


@register(
    "b06_direct_models",
    f"WITH {BRAND}, x AS (SELECT id, d, y, CASE WHEN count(*) OVER w28 >= 28 THEN avg(y) OVER w28 END AS x FROM panel0 WINDOW w28 AS ({O} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)), "
    f"e AS (SELECT a.id, h, a.x, b.y FROM x a, range(1, 29) g(h), x b WHERE b.id = a.id AND b.d = a.d + CAST(h AS INTEGER) AND a.x IS NOT NULL), "
    "k AS (SELECT id, h, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM e GROUP BY id, h), l AS (SELECT id, arg_max(x, d) AS x FROM x GROUP BY id) "
    "SELECT id, h AS horizon, n, round(slope, 5) AS slope, round(base + slope * x, 4) AS forecast FROM k JOIN l USING (id)",
)
def b06_models(spark, sf_dir):
    """28 models for each series, one a horizon: the value h days later from the mean of 28 days, fitted from one scan."""
    features = {"one": F.lit(1.0), "mean_28": W.rolling(F.avg, "y", series(), 28)}
    models, made = R.direct_models(brand_panel(spark, sf_dir, True), ["id"], "d", "y", features, _H)
    out = made.join(models, ["id", "horizon"])
    return out.select("id", F.col("horizon").cast("long").alias("horizon"), "n", r(F.col("weights")[1], 5).alias("slope"), r("forecast", 4).alias("forecast"))


@register("b06_direct_features")
def b06_features(spark, sf_dir):
    """The same with seven features: the last value, means of a week and four weeks, the yearly cycle and the weekend."""
    angle = F.dayofyear("d") * (2 * 3.141592653589793 / 365.25)
    features = {"one": F.lit(1.0), "last": F.col("y"), "mean_7": W.rolling(F.avg, "y", series(), 7), "mean_28": W.rolling(F.avg, "y", series(), 28), "sin": F.sin(angle), "cos": F.cos(angle), "weekend": (F.weekday("d") >= 5).cast("double")}
    _, made = R.direct_models(brand_panel(spark, sf_dir, True), ["id"], "d", "y", features, _H)
    return made.select("id", "horizon", r("forecast", 4).alias("forecast"))


@register("b07_multiplier_blend", f"WITH {FC} SELECT id, d, round((f * 1.035 + f * 1.03 + f * 1.025) / 3, 6) AS f FROM fc")
def b07(spark, sf_dir):
    f = F.col("f")
    return forecasts(spark, sf_dir).select("id", "d", r((f * 1.035 + f * 1.03 + f * 1.025) / 3).alias("f"))


@register("b08_fallback", f"WITH {FC} SELECT id, d, coalesce(nullif(f, 0), 1.0) AS f FROM fc")
def b08(spark, sf_dir):
    return forecasts(spark, sf_dir).select("id", "d", F.coalesce(F.nullif("f", F.lit(0.0)), F.lit(1.0)).alias("f"))


#: The nine levels of a quantile forecast.
_LEVELS = (0.005, 0.025, 0.165, 0.25, 0.5, 0.75, 0.835, 0.975, 0.995)


@register("q01_residual_quantiles", f"WITH {FC} SELECT date_diff('day', DATE '2001-01-01', d) % 28 + 1 AS step, " + ", ".join(f"round(quantile_cont(y - f, {q}), 6) AS q{k}" for k, q in enumerate(_LEVELS)) + " FROM fc GROUP BY 1")
def q01(spark, sf_dir):
    """By the step of the horizon: forecasts of 28 days are made at 2001-01-01 and every 28 days after it."""
    step = (F.date_diff("d", F.lit("2001-01-01").cast("date")) % 28 + 1).cast("long")
    f = forecasts(spark, sf_dir).groupBy(step.alias("step")).agg(F.percentile(F.col("y") - F.col("f"), F.array(*map(F.lit, _LEVELS))).alias("q"))
    return f.select("step", *[r(F.col("q")[k]).alias(f"q{k}") for k in range(len(_LEVELS))])


@register(
    "q06_quantile_regression",
    f"WITH {FC}, x AS (SELECT id, y / f AS k, sum(f) OVER (PARTITION BY id ORDER BY y / f ROWS UNBOUNDED PRECEDING) AS upto, sum(f) OVER (PARTITION BY id) AS total FROM fc WHERE f > 0) SELECT id, "
    + ", ".join(f"round(min(CASE WHEN upto >= {q} * total THEN k END), 6) AS q{k}" for k, q in enumerate(_LEVELS)) + " FROM x GROUP BY id",
)
def q06(spark, sf_dir):
    """For each series the factors k of y = k f with the least pinball loss: quantiles of y / f with weights f, which is the regression's exact solution."""
    f = forecasts(spark, sf_dir).where("f > 0").select("id", "f", (F.col("y") / F.col("f")).alias("k"))
    x = f.select("id", "k", F.sum("f").over(W.ordered(["id"], "k").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("f").over(W.by("id")).alias("total"))
    return x.groupBy("id").agg(*[r(F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("k")))).alias(f"q{k}") for k, q in enumerate(_LEVELS)])


_MOMENTS = "mo AS (SELECT id, avg(y) AS m, stddev_samp(y) AS s, max(y) AS top FROM panel0 GROUP BY id)"
_HEADS = {
    "gaussian": "-0.5 * pow((y - m) / s, 2) - ln(s) - 0.5 * ln(2 * pi())",
    "laplace": "-abs(y - m) / s - ln(2 * s)",
    "student_t": "lgamma(3) - lgamma(2.5) - 0.5 * ln(5 * pi()) - ln(s) - 3 * ln(1 + pow((y - m) / s, 2) / 5)",
    "poisson": "y * ln(m) - m - lgamma(y + 1)",
    "negative_binomial": "lgamma(y + 2) - lgamma(2) - lgamma(y + 1) - 2 * ln(1 + 0.5 * m) + y * ln(0.5 * m / (1 + 0.5 * m))",
    "gamma": "2 * ln(2 / m) - lgamma(2) + ln(y + 1) - 2 / m * (y + 1)",
    "beta": "ln((y + 1) / (top + 2)) + 2 * ln(1 - (y + 1) / (top + 2)) - lgamma(2) - lgamma(3) + lgamma(5)",
    "mixture": "ln(0.7 * exp(-0.5 * pow((y - m) / s, 2) - ln(s) - 0.5 * ln(2 * pi())) + 0.3 * exp(-abs(y - m) / s - ln(2 * s)))",
}


@register("q08_distribution_heads", f"WITH {BRAND}, {_MOMENTS} SELECT id, " + ", ".join(f"round(avg({e}), 6) AS {name}" for name, e in _HEADS.items()) + " FROM panel0 JOIN mo USING (id) GROUP BY id")
def q08(spark, sf_dir):
    """Mean log density of each series' days under distributions with its moments."""
    p = brand_panel(spark, sf_dir, True)
    x = p.join(p.groupBy("id").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s"), F.max("y").alias("top")), "id")
    y, m, s, two = F.col("y"), F.col("m"), F.col("s"), F.lit(2.0)
    heads = {
        "gaussian": D.gaussian(y, m, s), "laplace": D.laplace(y, m, s), "student_t": D.student_t(y, m, s, F.lit(5.0)), "poisson": D.poisson(y, m),
        "negative_binomial": D.negative_binomial(y, m, F.lit(0.5)), "gamma": D.gamma(y + 1, two, two / m), "beta": D.beta((y + 1) / (F.col("top") + 2), two, F.lit(3.0)),
        "mixture": D.mixture([D.gaussian(y, m, s), D.laplace(y, m, s)], [0.7, 0.3]),
    }
    return x.groupBy("id").agg(*[r(F.avg(c)).alias(name) for name, c in heads.items()])


#: Distribution functions of the heads below by other formulas: finite sums of whole parameters, and the series of the normal curve.
_PHI = "(0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(80), lambda k: z * exp(k * ln(nullif(z * z, 0)) - list_sum(list_transform(range(0, k + 1), lambda j: ln(2.0 * j + 1)))))))"
_SUM = "list_sum(list_transform(range(0, CAST(y AS BIGINT) + 1), lambda k: exp({})))"
_CDFS = {
    "gaussian": f"CASE WHEN z > 6 THEN 1 WHEN z < -6 THEN 0 WHEN z = 0 THEN 0.5 ELSE {_PHI} END",
    "laplace": "CASE WHEN y < m THEN exp((y - m) / s) / 2 ELSE 1 - exp((m - y) / s) / 2 END",
    "student_t": "0.5 + (atan(z / sqrt(5)) + sqrt(5) * z / (5 + z * z) * (1 + 2.0 / 3 * 5 / (5 + z * z))) / pi()",
    "poisson": _SUM.format("k * ln(m) - m - lgamma(k + 1)"),
    "negative_binomial": _SUM.format("ln(k + 1) - 2 * ln(1 + 0.5 * m) + k * ln(0.5 * m / (1 + 0.5 * m))"),
    "gamma": "1 - exp(-2 / m * (y + 1)) * (1 + 2 / m * (y + 1))",
    "beta": "6 * pow(b, 2) - 8 * pow(b, 3) + 3 * pow(b, 4)",
}


@register("q08_distribution_functions", f"WITH {BRAND}, {_MOMENTS}, x AS (SELECT id, y, m, s, (y - m) / s AS z, (y + 1) / (top + 2) AS b FROM panel0 JOIN mo USING (id)) SELECT id, " + ", ".join(f"round(avg({e}), 6) AS {name}" for name, e in _CDFS.items()) + " FROM x GROUP BY id")
def q08_cdf(spark, sf_dir):
    """Mean probability integral transform of each series' days (0.5 if a head fits); each distinct value is asked for once."""
    x, heads = _heads(spark, sf_dir)
    values = _spread(x.groupBy("id", "y", "m", "s", "top").agg(F.count("*").alias("n")), "id", "y")
    return values.groupBy("id").agg(*[r(F.sum(h.cdf(v) * F.col("n")) / F.sum("n")).alias(name) for name, (h, v) in heads.items() if name in _CDFS])


@register("q08_quantiles_and_scores")
def q08_quantiles(spark, sf_dir):
    """Three quantiles of every series' heads and the mean score (CRPS) of its last 28 days."""
    x, heads = _heads(spark, sf_dir)
    last = x.crossJoin(F.broadcast(x.agg(F.max("d").alias("hi")))).where("d > date_sub(hi, 28)")
    score = _spread(last, "id", "d").groupBy("id", "m", "s", "top").agg(*[F.avg(h.crps(v)).alias(name) for name, (h, v) in heads.items()])
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("head"), *[r(h.quantile(p), 5).alias(f"q{int(p * 100)}") for p in (0.1, 0.5, 0.9)], r(name, 5).alias("crps")) for name, (h, _) in heads.items()]))
    return _spread(score, "id").select("id", each)


def _spread(df, *keys):
    """Few rows that cost much each, dealt to all tasks: their bytes would fit one."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _heads(spark, sf_dir):
    """Days with the moments of their series, and heads by name with the value that they are asked for."""
    p = brand_panel(spark, sf_dir, True)
    x = p.join(p.groupBy("id").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s"), F.max("y").alias("top")), "id")
    y, m, s, two = F.col("y"), F.col("m"), F.col("s"), F.lit(2.0)
    return x, {
        "gaussian": (D.Gaussian(m, s), y), "laplace": (D.Laplace(m, s), y), "student_t": (D.StudentT(m, s, F.lit(5.0)), y), "poisson": (D.Poisson(m), y), "negative_binomial": (D.NegativeBinomial(m, F.lit(0.5)), y),
        "gamma": (D.Gamma(two, two / m), y + 1), "beta": (D.Beta(two, F.lit(3.0)), (y + 1) / (F.col("top") + 2)), "mixture": (D.Mixture((D.Gaussian(m, s), D.Gaussian(m * 1.5, s)), (0.7, 0.3)), y),
    }


@register("q02_normal_intervals", f"WITH {FC}, s AS (SELECT id, stddev_samp(y - f) AS sd FROM fc GROUP BY id) SELECT id, d, round(f + {normal_quantile(0.025)!r} * sd, 5) AS lo, round(f + {normal_quantile(0.975)!r} * sd, 5) AS hi FROM fc JOIN s USING (id)")
def q02(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    sd = f.groupBy("id").agg(F.stddev_samp(F.col("y") - F.col("f")).alias("sd"))
    return f.join(sd, "id").select("id", "d", *[r(B.normal_interval(F.col("f"), F.col("sd"), q), 5).alias(n) for q, n in ((0.025, "lo"), (0.975, "hi"))])


@register("q03_empirical_intervals", f"WITH {FC}, s AS (SELECT id, list_sort(list(abs(y - f))) AS e FROM fc GROUP BY id) SELECT id, e[CAST(ceil(0.5 * len(e)) AS BIGINT)] AS half, e[CAST(ceil(0.95 * len(e)) AS BIGINT)] AS wide FROM s")
def q03(spark, sf_dir):
    errors = forecasts(spark, sf_dir).select("id", F.abs(F.col("y") - F.col("f")).alias("e"))
    return B.nearest_ranks(errors, ["id"], "e", {"half": 0.5, "wide": 0.95})


_RATIOS = [(q, logit_ratio(q, 0.6) / logit_ratio(0.5, 0.6)) for q in _LEVELS]


@register("q04_analytic_ratios", f"WITH {FC}, q(q, ratio) AS (VALUES " + ", ".join(f"({q}::DOUBLE, {x!r}::DOUBLE)" for q, x in _RATIOS) + "), s AS (SELECT id, sum(f) AS f FROM fc GROUP BY id) SELECT id, q, round(f * ratio, 5) AS f FROM s, q")
def q04(spark, sf_dir):
    ratios = spark.createDataFrame(_RATIOS, "q double, ratio double")
    return forecasts(spark, sf_dir).groupBy("id").agg(F.sum("f").alias("f")).crossJoin(F.broadcast(ratios)).select("id", "q", r(F.col("f") * F.col("ratio"), 5).alias("f"))


@register("q05_history_blend", f"WITH {FC}, h AS (SELECT id, quantile_cont(y, 0.975) AS q FROM panel0 GROUP BY id), s AS (SELECT id, avg(f) AS m, max(f) AS x FROM fc GROUP BY id) SELECT id, round(0.2 * m + 0.7 * x + 0.1 * q, 6) AS f FROM s JOIN h USING (id)")
def q05(spark, sf_dir):
    h = brand_panel(spark, sf_dir, True).groupBy("id").agg(F.percentile("y", 0.975).alias("q"))
    s = forecasts(spark, sf_dir).groupBy("id").agg(F.avg("f").alias("m"), F.max("f").alias("x"))
    return s.join(h, "id").select("id", r(0.2 * F.col("m") + 0.7 * F.col("x") + 0.1 * F.col("q")).alias("f"))


@register("q07_samples_to_quantiles", f"WITH {EVENTS}, s AS (SELECT id, list_sort(list(v)) AS xs FROM ev GROUP BY id) SELECT id, round(xs[CAST(ceil(0.1 * len(xs)) AS BIGINT)], 6) AS q10, round(xs[CAST(ceil(0.9 * len(xs)) AS BIGINT)], 6) AS q90 FROM s")
def q07(spark, sf_dir):
    out = B.nearest_ranks(events_daily(spark, sf_dir), ["id"], "v", {"q10": 0.1, "q90": 0.9})
    return out.select("id", r("q10").alias("q10"), r("q90").alias("q90"))


def _models(spark, sf_dir):
    """id, d, y and three models' forecasts of the last year, in one pass over each series."""
    lags = {"a": 28, "b": 35, "c": 42}
    return brand_panel(spark, sf_dir, True).select("id", "d", "y", *[F.lag("y", k).over(series()).alias(name) for name, k in lags.items()]).where("d >= '2001-01-01'")


_MODELS = f"{BRAND}, m AS (SELECT id, d, lag(y, 28) OVER ({O}) AS a, lag(y, 35) OVER ({O}) AS b, lag(y, 42) OVER ({O}) AS c FROM panel0 QUALIFY d >= DATE '2001-01-01')"


@register("e01_mean_of_models", f"WITH {_MODELS} SELECT id, d, round((a + b + c) / 3, 6) AS f FROM m")
def e01(spark, sf_dir):
    return B.complete_mean(_models(spark, sf_dir), ["a", "b", "c"], "f").select("id", "d", r("f").alias("f"))


@register("e02_complete_cases", f"WITH {_MODELS} SELECT id, d, round((a + b + c) / 3, 6) AS f FROM m WHERE day(d) % 2 = 0")
def e02(spark, sf_dir):
    m = _models(spark, sf_dir).withColumn("b", F.when(F.day("d") % 2 == 0, F.col("b")))
    return B.complete_mean(m, ["a", "b", "c"], "f").select("id", "d", r("f").alias("f"))


@register("e03_weighted_blend", f"WITH {_MODELS}, x AS (SELECT id, d, 0.5 * a + 0.3 * b + 0.2 * c AS f FROM m) SELECT id, d, round(CASE WHEN f < 0.5 THEN 0 ELSE f * 1.02 END, 6) AS f FROM x")
def e03(spark, sf_dir):
    x = _models(spark, sf_dir).select("id", "d", B.weighted_blend({"a": 0.5, "b": 0.3, "c": 0.2}).alias("f"))
    return x.select("id", "d", r(F.when(F.col("f") < 0.5, 0.0).otherwise(F.col("f") * 1.02)).alias("f"))


@register("e04_best_strategy", f"WITH {_MODELS}, x AS (SELECT id, avg(abs(p.y - a)) AS a, avg(abs(p.y - b)) AS b, avg(abs(p.y - c)) AS c FROM m JOIN panel0 p USING (id, d) GROUP BY id) SELECT id, CASE WHEN a <= b AND a <= c THEN 'lag_28' WHEN b <= c THEN 'lag_35' ELSE 'lag_42' END AS best FROM x")
def e04(spark, sf_dir):
    names = {"a": "lag_28", "b": "lag_35", "c": "lag_42"}
    losses = _models(spark, sf_dir).groupBy("id").agg(*[F.avg(F.abs(F.col("y") - F.col(c))).alias(c) for c in names])
    return losses.select("id", F.array_min(F.array(*[F.struct(F.col(c).alias("e"), F.lit(name).alias("m")) for c, name in names.items()]))["m"].alias("best"))


_STRATEGIES = ("last_month", "last_year", "last_quarter")


#: Losses of the last twelve months on all levels: one row a series and month, with the weight of its series.
_LEVEL_LOSSES = (
    f"WITH {SALES}, s AS (SELECT region, store, cat, dept, item, year(d) * 12 + month(d) AS m, qty, price FROM sales), lv AS ({levels_sql('m, sum(qty) AS q, sum(price) AS p')}), hi AS (SELECT max(m) AS hi FROM s), "
    "full_ AS (SELECT level, group_id, m, sum(q) AS q, sum(p) AS p FROM (SELECT * FROM lv UNION ALL SELECT level, group_id, CAST(hi - k AS BIGINT), 0, 0 FROM (SELECT DISTINCT level, group_id FROM lv), hi, range(12) g(k)) GROUP BY ALL), "
    "f AS (SELECT level, group_id, m, q, p, coalesce(sum(q) OVER (PARTITION BY level, group_id ORDER BY m RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS last_month, coalesce(sum(q) OVER (PARTITION BY level, group_id ORDER BY m RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING), 0) AS last_year, coalesce(sum(q) OVER (PARTITION BY level, group_id ORDER BY m RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) / 3 AS last_quarter FROM full_), "
    "w AS (SELECT level, group_id, sum(p) AS w FROM f, hi WHERE m > hi - 24 AND m <= hi - 12 GROUP BY ALL), "
    "e AS (SELECT level, w, " + ", ".join("(" + " + ".join(f"greatest({q} * (q - {s_} * {x!r}), ({q} - 1) * (q - {s_} * {x!r}))" for q, x in _RATIOS) + f") / 9 AS {s_}" for s_ in _STRATEGIES) + " FROM f JOIN w USING (level, group_id), hi WHERE m > hi - 12)"
)


def level_losses(spark, sf_dir):
    """level, w and the mean pinball loss of nine quantiles under each strategy, for every series and month of the last year.

    Only the last two years enter, as the SQL's ranges reach no further back. A series' months are columns of one row, so that months without
    sales cost no rows; series without rows in the year before the last have no weight and are left out before months are listed.
    """
    facts = sales(spark, sf_dir).select(*H.DIMENSIONS, (F.year("d") * 12 + F.month("d")).alias("m"), "qty", "price")
    hi = facts.agg(F.max("m")).first()[0]
    frames = H.level_sums(facts.where(F.col("m") > F.lit(hi) - 24), H.LEVELS, ["m"], {"q": F.col("qty"), "p": F.col("price")})
    at = lambda k: F.coalesce(F.sum(F.when(F.col("m") == F.lit(hi) - k, F.col("q"))), F.lit(0.0))
    q = lambda k: F.col(f"q{k}")
    months = [F.struct(q(k).alias("q"), q(k + 1).alias("last_month"), q(k + 12).alias("last_year"), ((q(k + 1) + q(k + 2) + q(k + 3)) / 3).alias("last_quarter")) for k in range(12)]
    loss = {s: sum((M.pinball(F.col("q"), F.col(s) * x, q) for q, x in _RATIOS[1:]), M.pinball(F.col("q"), F.col(s) * _RATIOS[0][1], _RATIOS[0][0])) / len(_RATIOS) for s in _STRATEGIES}
    out = []
    for level in H.LEVELS:
        each = frames[tuple(level)].groupBy(*level).agg(F.sum(F.when(F.col("m") <= F.lit(hi) - 12, F.col("p"))).alias("w"), *[at(k).alias(f"q{k}") for k in range(24)])
        f = each.where("w is not null").select("w", F.inline(F.array(*months)))
        out.append(f.select(F.lit(H.level_name(level)).alias("level"), "w", *[loss[s].alias(s) for s in _STRATEGIES]))
    return reduce(DataFrame.unionByName, out)


@register(
    "e04_best_per_level",
    f"{_LEVEL_LOSSES}, a AS (SELECT level, " + ", ".join(f"sum(w * {x}) / sum(w) AS {x}" for x in _STRATEGIES) + " FROM e GROUP BY level) "
    "SELECT level, " + ", ".join(f"round({x}, 5) AS {x}" for x in _STRATEGIES) + ", CASE WHEN last_month <= last_year AND last_month <= last_quarter THEN 'last_month' WHEN last_year <= last_quarter THEN 'last_year' ELSE 'last_quarter' END AS best FROM a",
)
def e04_levels(spark, sf_dir):
    """On each of the twelve levels the strategy with the least mean pinball loss of nine quantiles, series weighted by last year's revenue."""
    a = level_losses(spark, sf_dir).groupBy("level").agg(*[M.weighted_mean(s, "w").alias(s) for s in _STRATEGIES])
    best = F.array_min(F.array(*[F.struct(F.col(s).alias("e"), F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(_STRATEGIES)]))["s"]
    return a.select("level", *[r(s, 5).alias(s) for s in _STRATEGIES], best.alias("best"))


#: Copies of a row by augmentation on levels without items, and the share of rows that sampling keeps on the two largest.
_AUGMENTED, _SAMPLED, _LARGE = 28, 2, ("region_item", "store_item")


@register(
    "m09_level_contribution",
    f"{_LEVEL_LOSSES}, a AS (SELECT level, sum(w * last_year) / sum(w) AS pinball, sum(w) * CASE WHEN contains(level, 'item') THEN 1 ELSE 1.0 / {_AUGMENTED} END * CASE WHEN level IN {_LARGE} THEN {_SAMPLED} ELSE 1 END AS weight FROM e GROUP BY level) "
    "SELECT level, round(pinball, 5) AS pinball, round(weight, 2) AS weight, round(pinball * weight / sum(pinball * weight) OVER (), 6) AS share FROM a",
)
def m09_levels(spark, sf_dir):
    """Each level's share of the loss: weights are divided by the copies that augmentation makes and multiplied where rows were sampled."""
    a = level_losses(spark, sf_dir).groupBy("level").agg(M.weighted_mean("last_year", "w").alias("pinball"), F.sum("w").alias("s"))
    out = M.contributions(a.select("level", "pinball", "s"), "level", "pinball", "s", _AUGMENTED, _SAMPLED, _LARGE)
    return out.select("level", r("pinball", 5).alias("pinball"), r("weight", 2).alias("weight"), r("share").alias("share"))


@register("e04_quantile_stack")
def e04_quantiles(spark, sf_dir):
    """For the total and the brands: linear combinations of three models with the least pinball loss at five quantiles, brands weighted by their units."""
    m = _models(spark, sf_dir)
    total = m.groupBy("d").agg(*[F.sum(c).alias(c) for c in ("y", "a", "b", "c")]).select(F.lit("total").alias("level"), "y", "a", "b", "c", F.lit(1.0).alias("w"))
    brands = m.select(F.lit("dept").alias("level"), "y", "a", "b", "c", F.avg("y").over(W.by("id")).alias("w"))
    out = R.quantile_weights(total.unionByName(brands), ["level"], "y", ["a", "b", "c"], [0.025, 0.25, 0.5, 0.75, 0.975], "w", rounds=16, tolerance=1e-4, smooth=1e-3)
    return out.select("level", "q", "n", *[r(F.col("weights")[k], 4).alias(f"weight_{c}") for k, c in enumerate("abc")])


_SUMS = {"aa": "a * a", "ab": "a * b", "bb": "b * b", "ya": "p.y * a", "yb": "p.y * b"}


@register(
    "e04_linear_stack",
    f"WITH {_MODELS}, s AS (SELECT id, " + ", ".join(f"sum({e}) AS {n}" for n, e in _SUMS.items()) + " FROM m JOIN panel0 p USING (id, d) GROUP BY id) SELECT id, round((bb * ya - ab * yb) / nullif(aa * bb - ab * ab, 0), 6) AS weight_a, round((aa * yb - ab * ya) / nullif(aa * bb - ab * ab, 0), 6) AS weight_b FROM s",
)
def e04_stack(spark, sf_dir):
    """For each series the least-squares weights of two models, from sums of products; null where the models are proportional."""
    x = brand_panel(spark, sf_dir, True).select("id", "d", "y", *W.lags("y", [28, 35], series())).where("d >= '2001-01-01'")
    return B.stack_two(x, ["id"], "y", "y_lag_28", "y_lag_35").select("id", r("weight_a").alias("weight_a"), r("weight_b").alias("weight_b"))


@register("e05_store_and_product", f"WITH {SALES}, a AS (SELECT store, sum(qty) AS s FROM sales GROUP BY store), b AS (SELECT store, sum(x) AS s FROM (SELECT store, item, avg(qty) * count(*) AS x FROM sales GROUP BY ALL) GROUP BY store) SELECT store, round((a.s + b.s) / 2, 4) AS f FROM a JOIN b USING (store)")
def e05(spark, sf_dir):
    s = sales(spark, sf_dir)
    a = s.groupBy("store").agg(F.sum("qty").alias("s"))
    b = s.groupBy("store", "item").agg((F.avg("qty") * F.count("*")).alias("x")).groupBy("store").agg(F.sum("x").alias("s"))
    return a.unionByName(b).groupBy("store").agg(r(F.avg("s"), 4).alias("f"))
