"""Queries F1 to F36 (scalar functions)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import scalars as S
from panelforge.operators import windows as W
from panelforge.plans.base import BRAND, EVENTS, brand_panel, events_daily, r, t
from panelforge.plans.registry import register

DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"


def _days(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()


def _day_query(name: str, columns, oracle: str) -> None:
    @register(name, f"WITH {DAYS} SELECT d, {oracle} FROM days")
    def query(spark, sf_dir):
        return _days(spark, sf_dir).select("d", *columns())


def _part_query(name: str, columns, oracle: str) -> None:
    @register(name, f"SELECT p_partkey, {oracle} FROM part")
    def query(spark, sf_dir):
        return t(spark, sf_dir, "part").select("p_partkey", *columns())


_part_query("f01_math", lambda: [r(F.sqrt(F.col("p_retailprice"))).alias("a"), r(F.abs(F.col("p_retailprice") - 1000)).alias("b"), r(F.log1p(F.col("p_retailprice"))).alias("c"), r(F.expm1(F.col("p_retailprice") / 1000)).alias("d"), r(F.log(F.col("p_retailprice"))).alias("e"), r(F.log10(F.col("p_retailprice"))).alias("f"), r(F.pow(F.col("p_retailprice"), F.lit(0.3))).alias("g")], "round(sqrt(p_retailprice), 6) AS a, round(abs(p_retailprice - 1000), 6) AS b, round(ln(1 + p_retailprice), 6) AS c, round(exp(p_retailprice / 1000) - 1, 6) AS d, round(ln(p_retailprice), 6) AS e, round(log10(p_retailprice), 6) AS f, round(pow(p_retailprice, 0.3), 6) AS g")
_day_query("f02_cyclic", lambda: [(r(S.cyclic(F.month("d"), 12)[0]) + 0.0).alias("s"), (r(S.cyclic(F.month("d"), 12)[1]) + 0.0).alias("c"), F.day(F.last_day("d")).cast("long").alias("n")], "round(sin(2 * pi() * month(d) / 12), 6) + 0.0 AS s, round(cos(2 * pi() * month(d) / 12), 6) + 0.0 AS c, day(last_day(d)) AS n")
_day_query("f03_week_of_month", lambda: [c.cast("long").alias(k) for k, c in S.week_of_month(F.col("d")).items()], "CAST(ceil(day(d) / 7) AS BIGINT) AS ceil, day(d) // 7 AS floor, least((day(d) - 1) // 7, 3) AS clipped")
_day_query("f04_date_parts", lambda: [F.day("d").cast("long").alias("day"), F.weekofyear("d").cast("long").alias("week"), F.month("d").cast("long").alias("month"), F.quarter("d").cast("long").alias("quarter"), F.year("d").cast("long").alias("year"), F.dayofyear("d").cast("long").alias("doy"), F.weekday("d").cast("long").alias("dow")], "day(d) AS day, week(d) AS week, month(d) AS month, quarter(d) AS quarter, year(d) AS year, dayofyear(d) AS doy, isodow(d) - 1 AS dow")
_day_query("f05_weekend", lambda: [(F.weekday("d") >= 5).alias("weekend")], "isodow(d) >= 6 AS weekend")
_day_query("f06_date_arithmetic", lambda: [F.date_add("d", 4).alias("a"), F.date_sub("d", 28).alias("b"), F.to_date(F.add_months("d", 1)).alias("c")], "CAST(d + 4 AS DATE) AS a, CAST(d - 28 AS DATE) AS b, CAST(d + INTERVAL 1 MONTH AS DATE) AS c")
_day_query("f07_leap_day", lambda: [F.when((F.month("d") == 2) & (F.day("d") == 29), F.date_sub("d", 1)).otherwise(F.col("d")).alias("m")], "CASE WHEN month(d) = 2 AND day(d) = 29 THEN CAST(d - 1 AS DATE) ELSE d END AS m")


@register("f08_year_offset", f"WITH {DAYS} SELECT d, year(d) - (SELECT min(year(d)) FROM days) AS y FROM days")
def f08(spark, sf_dir):
    days = _days(spark, sf_dir)
    return days.crossJoin(F.broadcast(days.agg(F.min(F.year("d")).alias("lo")))).select("d", (F.year("d") - F.col("lo")).cast("long").alias("y"))


_part_query("f09_string_slice", lambda: [F.substring("p_brand", 7, 10).cast("long").alias("n"), F.left("p_name", F.length("p_name") - 2).alias("head")], "CAST(substr(p_brand, 7) AS BIGINT) AS n, left(p_name, -2) AS head")
_part_query("f10_split_join", lambda: [F.element_at(F.split("p_brand", "#"), 2).alias("b"), F.concat_ws("_", F.split("p_name", " ")).alias("j")], "split_part(p_brand, '#', 2) AS b, array_to_string(string_split(p_name, ' '), '_') AS j")
_part_query("f11_regex_replace", lambda: [F.regexp_replace("p_brand", "[0-9]+$", "X").alias("b")], "regexp_replace(p_brand, '[0-9]+$', 'X') AS b")
_part_query("f12_concat_format", lambda: [F.concat_ws("_", "p_brand", F.format_string("%.3f", F.col("p_size") / 8), F.lit("evaluation")).alias("k")], "p_brand || '_' || printf('%.3f', p_size / 8) || '_evaluation' AS k")
_part_query("f13_fraction_digits", lambda: [F.pmod(F.round(F.col("p_retailprice") * 100).cast("long"), F.lit(100)).alias("cents")], "CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS cents")


@register("f14_label_encode", "SELECT p_partkey, dense_rank() OVER (ORDER BY coalesce(p_type, 'NA')) - 1 AS code FROM part")
def f14(spark, sf_dir):
    return S.label_encode(t(spark, sf_dir, "part"), "p_type", "code").select("p_partkey", "code")


@register("f15_factorize", "WITH f AS (SELECT p_type, min(p_partkey) AS k FROM part GROUP BY 1), c AS (SELECT p_type, row_number() OVER (ORDER BY k) - 1 AS code FROM f) SELECT p_partkey, coalesce(code, -1) AS code FROM part LEFT JOIN c USING (p_type)")
def f15(spark, sf_dir):
    return S.factorize(t(spark, sf_dir, "part"), "p_type", ["p_partkey"], "code").select("p_partkey", "code")


@register("f16_shared_codes", "WITH v AS (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region), c AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM v) SELECT n_name, a.code AS nation_code, b.code AS region_code FROM nation JOIN region ON n_regionkey = r_regionkey JOIN c a ON a.x = n_name JOIN c b ON b.x = r_name")
def f16(spark, sf_dir):
    pairs = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    both = pairs.select(F.col("n_name").alias("x")).unionByName(pairs.select(F.col("r_name").alias("x"))).distinct()
    codes = S.dense_codes(both.select("x"), "x", "code")
    a, b = codes.select(F.col("x").alias("n_name"), F.col("code").alias("nation_code")), codes.select(F.col("x").alias("r_name"), F.col("code").alias("region_code"))
    return pairs.join(a, "n_name").join(b, "r_name").select("n_name", "nation_code", "region_code")


_STATUS = ("F", "O", "P")


@register("f17_one_hot", "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{s}' AS INTEGER) AS is_{s}" for s in _STATUS) + " FROM orders")
def f17(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", *[(F.col("o_orderstatus") == s).cast("int").alias(f"is_{s}") for s in _STATUS])


_GRID = [k / 10 for k in range(-20, 41)]
_POWER = "CASE WHEN y >= 0 THEN CASE WHEN lam = 0 THEN ln(abs(y) + 1) ELSE (pow(abs(y) + 1, lam) - 1) / lam END ELSE -CASE WHEN lam = 2 THEN ln(abs(y) + 1) ELSE (pow(abs(y) + 1, 2 - lam) - 1) / (2 - lam) END END"


@register(
    "f18_scaling",
    f"""WITH x AS (SELECT *, (p_size - 25)::DOUBLE AS y FROM part), z AS (SELECT lam, y, {_POWER} AS z FROM x, (SELECT k / 10 AS lam FROM range(-20, 41) g(k))),
l AS (SELECT lam, (lam - 1) * sum(sign(y) * ln(abs(y) + 1)) - count(*) / 2 * ln(var_pop(z)) AS ll FROM z GROUP BY lam), b AS (SELECT arg_max(lam, ll) AS lam FROM l)
SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6) AS mm, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 5) AS z,
  lam, round({_POWER}, 6) AS power FROM x, b""",
)
def f18(spark, sf_dir):
    """Min-max, standard and power scaling; the power's exponent is fitted by likelihood over a grid."""
    price = F.col("p_retailprice")
    p = t(spark, sf_dir, "part").withColumn("y", (F.col("p_size") - 25).cast("double"))
    facts = p.agg(F.min(price).alias("lo"), F.max(price).alias("hi"), F.avg(price).alias("m"), F.stddev_pop(price).alias("s"))
    one = facts.crossJoin(S.fit_yeo_johnson(p, "y", _GRID))  # one row
    return p.crossJoin(F.broadcast(one)).select("p_partkey", r((price - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("mm"), r((price - F.col("m")) / F.col("s"), 5).alias("z"), "lam", r(S.yeo_johnson(F.col("y"), F.col("lam"))).alias("power"))


@register("f19_scale_nonzero_mean", f"WITH {BRAND} SELECT id, d, round(y / avg(CASE WHEN y <> 0 THEN y END) OVER (PARTITION BY id), 6) AS scaled FROM panel0")
def f19(spark, sf_dir):
    return brand_panel(spark, sf_dir, True).select("id", "d", r(F.try_divide("y", F.avg(F.when(F.col("y") != 0, F.col("y"))).over(W.by("id")))).alias("scaled"))


@register("f20_normalise", f"WITH {BRAND}, s AS (SELECT id, d, y / (1 + lag(y, 28) OVER (PARTITION BY id ORDER BY d)) AS n, 1 + lag(y, 28) OVER (PARTITION BY id ORDER BY d) AS s FROM panel0) SELECT id, d, round(n, 6) AS n, round(n * s, 6) AS back FROM s")
def f20(spark, sf_dir):
    scale = 1 + F.lag("y", 28).over(W.ordered(["id"], "d"))
    s = brand_panel(spark, sf_dir, True).select("id", "d", (F.col("y") / scale).alias("n"), scale.alias("s"))
    return s.select("id", "d", r("n").alias("n"), r(F.col("n") * F.col("s")).alias("back"))


#: Holidays by state. (name, month, day, observed when at the weekend) or (name, month, weekday from Monday 0, which of the month; -1 the last); None: all states.
_FIXED = [("new_year", 1, 1, True, None), ("independence_day", 7, 4, True, None), ("veterans_day", 11, 11, True, None), ("christmas", 12, 25, True, None), ("cesar_chavez_day", 3, 31, False, "AMERICA"), ("christmas_eve", 12, 24, False, "EUROPE"), ("early_spring_day", 3, 2, False, "ASIA")]
_FLOATING = [("martin_luther_king", 1, 0, 3, None), ("washington", 2, 0, 3, None), ("memorial_day", 5, 0, -1, None), ("labor_day", 9, 0, 1, None), ("thanksgiving", 11, 3, 4, None), ("columbus_day", 10, 0, 2, "AMERICA")]


def _holiday_sql() -> str:
    shift = "CASE isodow({0}) WHEN 6 THEN {0} - 1 WHEN 7 THEN {0} + 1 ELSE {0} END"
    parts = []
    for name, m, d, moved, state in _FIXED:
        day = f"make_date(yr, {m}, {d})"
        parts.append((name, shift.format(day) if moved else day, state))
    for name, m, wd, n, state in _FLOATING:
        first, last = f"make_date(yr, {m}, 1)", f"last_day(make_date(yr, {m}, 1))"
        parts.append((name, f"{first} + CAST(({wd + 1} - isodow({first}) + 7) % 7 + {7 * (n - 1)} AS INTEGER)" if n > 0 else f"{last} - CAST((isodow({last}) - {wd + 1} + 7) % 7 AS INTEGER)", state))
    return " UNION ALL ".join(f"SELECT r_name AS state, CAST({day} AS DATE) AS d, '{name}' AS name FROM yrs, region" + (f" WHERE r_name = '{state}'" if state else "") for name, day, state in parts)


@register("f21_holidays_by_state", f"WITH {DAYS}, yrs AS (SELECT unnest(range(min(year(d)), max(year(d)) + 2)) AS yr FROM days), h AS ({_holiday_sql()}) SELECT d, r_name AS state, min(name) AS holiday, count(name) > 0 AS is_holiday FROM days CROSS JOIN region LEFT JOIN h ON h.d = days.d AND state = r_name GROUP BY days.d, r_name".replace("SELECT d, r_name AS state, min", "SELECT days.d AS d, r_name AS state, min"))
def f21_states(spark, sf_dir):
    """Every day of the calendar in every state: holidays on fixed days, kept on the next working day, and on n-th weekdays, some of them in one state only."""
    days = _days(spark, sf_dir).select("d")
    years = days.agg(F.min(F.year("d")).alias("lo"), F.max(F.year("d")).alias("hi")).select(F.explode(F.sequence(F.col("lo"), F.col("hi") + 1)).alias("yr"))
    yr = F.col("yr")
    fixed = [(n, S.observed(F.make_date(yr, F.lit(m), F.lit(d))) if moved else F.make_date(yr, F.lit(m), F.lit(d)), state) for n, m, d, moved, state in _FIXED]
    rows = fixed + [(n, S.nth_weekday(yr, m, wd, k), state) for n, m, wd, k, state in _FLOATING]
    table = years.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), day.alias("d"), F.lit(state).alias("only")) for n, day, state in rows])))
    states = t(spark, sf_dir, "region").select(F.col("r_name").alias("state"))
    h = table.join(F.broadcast(states), F.col("only").isNull() | (F.col("only") == F.col("state"))).groupBy("d", "state").agg(F.min("name").alias("holiday"))  # a few rows a year and state
    return days.crossJoin(F.broadcast(states)).join(F.broadcast(h), ["d", "state"], "left").select("d", "state", "holiday", F.col("holiday").isNotNull().alias("is_holiday"))


@register("f21_holiday_table", f"WITH {DAYS}, h(m, dd, name) AS (VALUES (1, 1, 'new_year'), (7, 4, 'independence'), (12, 25, 'christmas')) SELECT d, name IS NOT NULL AS is_holiday FROM days LEFT JOIN h ON month(d) = m AND day(d) = dd")
def f21(spark, sf_dir):
    h = spark.createDataFrame([(1, 1, "new_year"), (7, 4, "independence"), (12, 25, "christmas")], "m int, dd int, name string")
    return _days(spark, sf_dir).join(F.broadcast(h), (F.month("d") == F.col("m")) & (F.day("d") == F.col("dd")), "left").select("d", F.col("name").isNotNull().alias("is_holiday"))


_day_query("f22_moon_phase", lambda: [S.moon_phase(F.col("d")).alias("phase")], "CAST(floor(((0.20439731::DOUBLE + date_diff('day', DATE '2001-01-01', d) * 0.03386319269::DOUBLE) - floor(0.20439731::DOUBLE + date_diff('day', DATE '2001-01-01', d) * 0.03386319269::DOUBLE)) * 8 + 0.5) AS BIGINT) % 8 AS phase")
def _christmas():
    return F.date_diff("d", F.make_date(F.year("d"), F.lit(12), F.lit(25)))


_day_query("f23_holiday_distance", lambda: [_christmas().cast("long").alias("dist"), (_christmas() == 0).alias("hit"), r(F.exp(-F.abs(_christmas()) / 10)).alias("e1"), r(F.exp(-(_christmas() * _christmas()) / 100)).alias("e2")], "date_diff('day', make_date(year(d), 12, 25), d) AS dist, date_diff('day', make_date(year(d), 12, 25), d) = 0 AS hit, round(exp(-abs(date_diff('day', make_date(year(d), 12, 25), d)) / 10), 6) AS e1, round(exp(-pow(date_diff('day', make_date(year(d), 12, 25), d), 2) / 100), 6) AS e2")


@register("f24_scaled_time", "SELECT event_id, round(minute(ts) / 59 - 0.5, 6) AS mi, round(hour(ts) / 23 - 0.5, 6) AS ho, round((isodow(ts) - 1) / 6 - 0.5, 6) AS dow, round((day(ts) - 1) / 30 - 0.5, 6) AS dom FROM events")
def f24(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", r(F.minute("ts") / 59 - 0.5).alias("mi"), r(F.hour("ts") / 23 - 0.5).alias("ho"), r(F.weekday("ts") / 6 - 0.5).alias("dow"), r((F.day("ts") - 1) / 30 - 0.5).alias("dom"))


@register("f25_lag_list", "SELECT CAST(unnest([1, 2, 3, 4, 5, 6, 7, 8, 13, 14, 15, 20, 21, 22]) AS BIGINT) AS lag")
def f25(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in S.lag_list(7, 1, 3)], "lag long")


@register("f26_age", f"WITH {BRAND} SELECT id, d, round(log10(1 + row_number() OVER (PARTITION BY id ORDER BY d)), 6) AS age FROM panel0")
def f26(spark, sf_dir):
    return brand_panel(spark, sf_dir).select("id", "d", r(F.log10(1 + F.row_number().over(W.ordered(["id"], "d")))).alias("age"))


@register("f27_observed", f"WITH {BRAND} SELECT id, d, coalesce(y, 0) AS y, CAST(y IS NOT NULL AS INTEGER) AS observed FROM panel")
def f27(spark, sf_dir):
    return brand_panel(spark, sf_dir).select("id", "d", F.coalesce("y", F.lit(0.0)).alias("y"), F.col("y").isNotNull().cast("int").alias("observed"))


@register("f28_guarded_ratio", f"WITH {BRAND}, s AS (SELECT id, d, y, lag(y) OVER (PARTITION BY id ORDER BY d) AS z FROM panel0) SELECT id, d, round(CASE WHEN z = 0 THEN 0 ELSE y / z END, 6) AS ratio FROM s")
def f28(spark, sf_dir):
    z = F.lag("y").over(W.ordered(["id"], "d"))
    return brand_panel(spark, sf_dir, True).select("id", "d", r(F.when(z == 0, 0.0).otherwise(F.try_divide("y", z))).alias("ratio"))


@register("f29_array_functions", f"WITH {EVENTS}, s AS (SELECT id, list(n ORDER BY d) AS xs FROM ev GROUP BY id) SELECT id, list_max(xs) AS top, list_position(xs, list_max(xs)) - 1 AS argmax, xs[2] - xs[1] AS first_diff, list_sum(list_transform(xs, lambda x: x * x))::BIGINT AS squares FROM s")
def f29(spark, sf_dir):
    s = events_daily(spark, sf_dir).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "n"))), lambda x: x["n"]).alias("xs"))
    top = F.array_max("xs")
    return s.select("id", top.alias("top"), (F.array_position("xs", top) - 1).alias("argmax"), (F.col("xs")[1] - F.col("xs")[0]).alias("first_diff"), F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("squares"))


@register("f30_normal_quantiles", "SELECT * FROM (VALUES (0.025, -1.959964), (0.25, -0.67449), (0.5, 0.0), (0.75, 0.67449), (0.975, 1.959964)) v(q, z)")
def f30(spark, sf_dir):
    return spark.createDataFrame([(q, round(S.normal_quantile(q), 6) + 0.0) for q in (0.025, 0.25, 0.5, 0.75, 0.975)], "q double, z double")


_EDGES = (5.0, 10.0, 20.0, 40.0)
_part_query("f31_binning", lambda: [S.bin_index(F.col("p_size"), list(_EDGES)).alias("bin")], " + ".join(f"CAST(p_size >= {e} AS BIGINT)" for e in _EDGES) + " AS bin")


_LOCAL, _GLOBAL = [k / 4 for k in range(5)], [0.99 * k / 4 for k in range(5)]
_EDGES_SQL = "list_transform([1, 2, 3, 4], lambda k: ({c}[k] + {c}[k + 1]) / 2)"
_BIN_SQL = "len(list_filter({e}, lambda e: e <= {y})) + 1"


@register(
    "f31_panel_binning",
    f"""WITH {BRAND}, a AS (SELECT avg(abs(y)) AS m FROM panel0), s AS (SELECT id, coalesce(nullif(avg(abs(y)), 0), any_value(m)) AS scale, quantile_cont(y, {_LOCAL}) AS c FROM panel0, a GROUP BY id),
x AS (SELECT p.id, d, y, y / scale AS scaled, {_EDGES_SQL.format(c="c")} AS own FROM panel0 p JOIN s ON p.id = s.id), g AS (SELECT quantile_cont(scaled, {_GLOBAL}) AS c FROM x), h AS (SELECT list_transform({_EDGES_SQL.format(c="c")}, lambda e: round(e, 6)) AS every FROM g)
SELECT id, d, round(scaled, 6) AS scaled, {_BIN_SQL.format(e="own", y="y")} AS own_bin, {_BIN_SQL.format(e="every", y="round(scaled, 6)")} AS global_bin, ({_BIN_SQL.format(e="own", y="y")}) / 5 AS pit FROM x, h""",
)
def f31_panel(spark, sf_dir):
    """Scaling by the mean absolute value (of all series where a series has none but 0), bins around quantiles of the own series and of all scaled ones, and the discrete probability integral transform.
    Scaled values and their edges are compared at six digits, so that equal ones are equal whatever their last bits."""
    p = brand_panel(spark, sf_dir, True)
    size = F.avg(F.abs("y"))
    own = p.groupBy("id").agg(size.alias("size"), F.percentile("y", F.array(*map(F.lit, _LOCAL))).alias("c")).crossJoin(F.broadcast(p.agg(size.alias("m"))))
    own = own.select("id", F.coalesce(F.nullif("size", F.lit(0.0)), "m").alias("scale"), S.midpoints(F.col("c")).alias("own"))
    x = p.join(own, "id").select("id", "d", "y", F.try_divide("y", "scale").alias("scaled"), "own")
    every = x.agg(F.percentile("scaled", F.array(*map(F.lit, _GLOBAL))).alias("c")).select(F.transform(S.midpoints(F.col("c")), lambda e: F.round(e, 6)).alias("every"))
    b = S.digitise(F.col("y"), F.col("own"))
    return x.crossJoin(F.broadcast(every)).select("id", "d", r("scaled").alias("scaled"), b.alias("own_bin"), S.digitise(F.round("scaled", 6), F.col("every")).alias("global_bin"), (b / 5).alias("pit"))


_part_query("f32_box_cox", lambda: [r(S.box_cox(F.col("p_retailprice"), 0.4)).alias("z"), r(S.inverse_box_cox(S.box_cox(F.col("p_retailprice"), 0.4), 0.4), 3).alias("back"), r(S.box_cox(F.col("p_retailprice"), 0)).alias("z0")], "round((pow(p_retailprice, 0.4) - 1) / 0.4, 6) AS z, round(p_retailprice, 3) AS back, round(ln(p_retailprice), 6) AS z0")
_day_query("f33_fourier", lambda: [c for k in (1, 2) for c in (r(F.cos(2 * math.pi * k * F.dayofyear("d") / 365)).alias(f"c{k}"), r(F.sin(2 * math.pi * k * F.dayofyear("d") / 365)).alias(f"s{k}"))], ", ".join(f"round(cos(2 * pi() * {k} * dayofyear(d) / 365), 6) AS c{k}, round(sin(2 * pi() * {k} * dayofyear(d) / 365), 6) AS s{k}" for k in (1, 2)))


@register("f34_kernels", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * exp(-pow(a.n_nationkey - b.n_nationkey, 2) / 18.0), 6) AS rbf, round(exp(-2 * pow(sin(pi() * abs(a.n_nationkey - b.n_nationkey) / 7), 2)), 6) AS per FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def f34(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", r(S.rbf(F.col("a"), F.col("b"), 2.0, 3.0)).alias("rbf"), r(S.periodic(F.col("a"), F.col("b"), 1.0, 1.0, 7.0)).alias("per"))


_part_query("f35_quantise", lambda: [F.width_bucket(F.col("p_retailprice") / 1000, F.lit(0.0), F.lit(3.0), F.lit(16)).alias("bin")], "CAST(least(greatest(floor(p_retailprice / 1000 / 3.0 * 16), -1), 16) + 1 AS BIGINT) AS bin")


_HASHED = "(('0x' || substr(sha256('{seed}-' || CAST(p_partkey AS VARCHAR)), 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE"


@register("f36_noise", f"SELECT p_partkey, round(p_retailprice * (1 + 0.01 * sqrt(-2 * ln({_HASHED.format(seed='a')})) * cos(2 * pi() * {_HASHED.format(seed='b')})), 6) AS noisy FROM part")
def f36(spark, sf_dir):
    """Normal noise of one percent; both uniform numbers come from the key's hash, so a run repeats."""
    u = [(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}-"), F.col("p_partkey").cast("string")), 256), 1, 12), 16, 10).cast("long") + 1) / F.lit(281474976710657.0) for seed in "ab"]
    normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])
    return t(spark, sf_dir, "part").select("p_partkey", r(F.col("p_retailprice") * (1 + 0.01 * normal)).alias("noisy"))
