"""Queries J1 to J21 (joins), AG1 to AG27 (aggregations), O1 to O11 (sorts, limits, sampling) and SO1 to SO7 (set operations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalars as S
from panelforge.operators import hierarchy as H
from panelforge.operators import joins as J
from panelforge.operators import metrics as M
from panelforge.operators import sampling
from panelforge.operators import windows as W
from panelforge.plans.base import BRAND, EVENTS, SALES, brand_daily, brand_panel, events_daily, levels_sql, r, sales, t
from panelforge.plans.registry import register
from panelforge.session import checkpoint


def _simple(name: str, oracle: str):
    return register(name, oracle)


@_simple("j01_left_dimension", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j01(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t(spark, sf_dir, "customer").join(F.broadcast(n), "c_nationkey", "left").select("c_custkey", "n_name")


_WEEK = "w AS (SELECT l_partkey, l_suppkey, date_trunc('week', l_shipdate)::DATE AS wk, round(avg(l_extendedprice / l_quantity), 8) AS price FROM lineitem GROUP BY ALL)"


@_simple("j02_left_three_keys", f"WITH {_WEEK} SELECT l_orderkey, l_linenumber, price FROM lineitem l LEFT JOIN w ON l.l_partkey = w.l_partkey AND l.l_suppkey = w.l_suppkey AND date_trunc('week', l.l_shipdate)::DATE = wk")
def j02(spark, sf_dir):
    line = t(spark, sf_dir, "lineitem").withColumn("wk", F.to_date(F.date_trunc("week", "l_shipdate")))
    weekly = line.groupBy("l_partkey", "l_suppkey", "wk").agg(r(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 8).alias("price"))
    return line.join(weekly, ["l_partkey", "l_suppkey", "wk"], "left").select("l_orderkey", "l_linenumber", "price")


@_simple("j03_inner", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j03(spark, sf_dir):
    return t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@_simple("j04_natural", f"WITH {EVENTS}, m AS (SELECT id, d, n AS n2 FROM ev WHERE n > 2) SELECT id, d, n, n2 FROM ev NATURAL JOIN m")
def j04(spark, sf_dir):
    ev = events_daily(spark, sf_dir).select("id", "d", "n")
    return J.natural(ev, ev.where("n > 2").withColumnRenamed("n", "n2"))


@_simple("j05_other_key_names", "SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j05(spark, sf_dir):
    n = t(spark, sf_dir, "nation").join(F.broadcast(t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")


@_simple("j06_index_level_join", "WITH a AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, sum(l_quantity) AS tot FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_partkey, q, tot FROM a JOIN b USING (l_suppkey)")
def j06(spark, sf_dir):
    a = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return a.join(a.groupBy("l_suppkey").agg(F.sum("q").alias("tot")), "l_suppkey")


@_simple("j07_right_outer", "SELECT c_custkey, count(o_orderkey) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey")
def j07(spark, sf_dir):
    return t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@_simple("j08_full_outer_fold", "SELECT k, a, b, c FROM (SELECT l_suppkey AS k, count(*) AS a FROM lineitem WHERE l_quantity > 49 GROUP BY 1) FULL JOIN (SELECT l_suppkey AS k, count(*) AS b FROM lineitem WHERE l_quantity < 2 GROUP BY 1) USING (k) FULL JOIN (SELECT s_suppkey AS k, 1::BIGINT AS c FROM supplier WHERE s_acctbal < 0) USING (k)")
def j08(spark, sf_dir):
    line = t(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    a, b = line.where("l_quantity > 49").groupBy("k").agg(F.count("*").alias("a")), line.where("l_quantity < 2").groupBy("k").agg(F.count("*").alias("b"))
    return J.full_outer_all([a, b, t(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("k"), F.lit(1).cast("long").alias("c"))], ["k"])


@_simple("j09_provenance", "SELECT k, CASE WHEN a IS NULL THEN 'right_only' WHEN b IS NULL THEN 'left_only' ELSE 'both' END AS src FROM (SELECT DISTINCT l_partkey AS k, 1 AS a FROM lineitem WHERE l_quantity > 45) FULL JOIN (SELECT p_partkey AS k, 1 AS b FROM part WHERE p_size > 25) USING (k)")
def j09(spark, sf_dir):
    a = t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k"), F.lit(1).alias("a")).distinct()
    b = t(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("k"), F.lit(1).alias("b"))
    return a.join(b, "k", "full").select("k", F.when(F.col("a").isNull(), "right_only").when(F.col("b").isNull(), "left_only").otherwise("both").alias("src"))


@_simple("j10_cross", "SELECT r_name, n_name FROM region, nation")
def j10(spark, sf_dir):
    return t(spark, sf_dir, "region").crossJoin(F.broadcast(t(spark, sf_dir, "nation"))).select("r_name", "n_name")


@_simple("j11_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def j11(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("x")), n.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("y"))
    return a.join(b, "k").where("x <> y").select("a", "b")


@_simple("j12_asof", "WITH v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') SELECT p.event_id, v.event_id AS last_view, v.value AS last_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts")
def j12(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"), F.col("value").alias("last_value"))
    return J.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "ts", ["user_id"], ["last_view", "last_value"], "last_view").select("event_id", "last_view", "last_value")


@_simple("j13_validated", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def j13(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return J.validated(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), p, ["l_partkey"]).select("l_orderkey", "l_linenumber", "p_brand")


@_simple("j14_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'part' END AS status FROM orders")
def j14(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("F", "finished", "O", "open", "P", "part")])
    return t(spark, sf_dir, "orders").select("o_orderkey", F.try_element_at(names, "o_orderstatus").alias("status"))


@_simple("j15_left_keeps_types", "SELECT s_suppkey, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j15(spark, sf_dir):
    return t(spark, sf_dir, "supplier").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_regionkey")


@_simple("j16_column_concat_by_key", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def j16(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    return s.select("s_suppkey", "s_name").join(s.select("s_suppkey", "s_acctbal"), "s_suppkey")


@_simple("j17_parent_to_children", f"WITH {SALES}, c AS (SELECT cat, round(avg(qty), 6) AS cat_mean FROM sales GROUP BY cat), i AS (SELECT item, cat, sum(qty) AS q FROM sales GROUP BY ALL) SELECT item, q, cat_mean FROM i JOIN c USING (cat)")
def j17(spark, sf_dir):
    s = sales(spark, sf_dir)
    return s.groupBy("item", "cat").agg(F.sum("qty").alias("q")).join((s.groupBy("cat").agg(r(F.avg("qty")).alias("cat_mean"))), "cat").select("item", "q", "cat_mean")


@_simple("j18_shifted_self_join", f"WITH {BRAND} SELECT id, d, y_7 FROM (SELECT id, d, lead(y, 7) OVER (PARTITION BY id ORDER BY d) AS y_7 FROM panel0) WHERE y_7 IS NOT NULL")
def j18(spark, sf_dir):
    return J.shifted(brand_panel(spark, sf_dir, True), ["id"], "d", "y", 7, "y_7").select("id", "d", "y_7")


@_simple("j19_parent_child", f"WITH {BRAND}, tot AS (SELECT d, sum(y) AS total FROM panel0 GROUP BY d) SELECT id, d, round(y / nullif(total, 0), 10) AS share FROM panel0 JOIN tot USING (d)")
def j19(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True)
    return p.join(p.groupBy("d").agg(F.sum("y").alias("total")), "d").select("id", "d", r(F.try_divide("y", "total"), 10).alias("share"))


@_simple("j20_summing_matrix", "WITH y AS (SELECT l_suppkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1), b AS (SELECT s_suppkey AS k, 'nation' AS level, n_name AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, 'total', 'Total_X' FROM supplier) SELECT level, g, sum(q) AS q FROM y JOIN b USING (k) GROUP BY ALL")
def j20(spark, sf_dir):
    y = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("q"))
    s = t(spark, sf_dir, "supplier").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    bridge = s.select(F.col("s_suppkey").alias("k"), F.lit("nation").alias("level"), F.col("n_name").alias("g")).unionByName(s.select(F.col("s_suppkey").alias("k"), F.lit("total").alias("level"), F.lit("Total_X").alias("g")))
    return J.bridge_sum(y, bridge, "k", ["level", "g"], "q")


@_simple("j21_semi_anti", "SELECT p_partkey, 'sold' AS k FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT p_partkey, 'unsold' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
def j21(spark, sf_dir):
    sold = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("k", F.lit("sold"))
    return t(spark, sf_dir, "part").select("p_partkey").join(sold, "p_partkey", "left").select("p_partkey", F.coalesce("k", F.lit("unsold")).alias("k"))


@_simple("ag01_release_day", "SELECT l_partkey, l_suppkey, CAST(min(l_shipdate) AS DATE) AS release FROM lineitem GROUP BY ALL")
def ag01(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.to_date(F.min("l_shipdate")).alias("release"))


@_simple("ag02_basic", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS s, round(avg(l_extendedprice), 4) AS m, max(l_tax) AS hi, count(*) AS n, round(stddev_samp(l_quantity), 5) AS sd FROM lineitem GROUP BY ALL")
def ag02(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("s"), r(F.avg("l_extendedprice"), 4).alias("m"), F.max("l_tax").alias("hi"), F.count("*").alias("n"), r(F.stddev_samp("l_quantity"), 5).alias("sd"))


@_simple("ag03_named", "SELECT o_custkey, count(o_orderkey) AS order_count, max(o_totalprice) AS top_price FROM orders GROUP BY o_custkey")
def ag03(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("order_count"), F.max("o_totalprice").alias("top_price"))


@_simple("ag04_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def ag04(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12")


@_simple("ag05_first_by_order", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY o_custkey")
def ag05(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"))


@_simple("ag06_distinct_count", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey")
def ag06(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n"))


@_simple("ag07_value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def ag07(spark, sf_dir):
    return t(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))


_YEARLY = f"WITH {SALES}, s AS (SELECT year(d) AS yr, region, store, cat, dept, item, qty, price FROM sales)"


@_simple("ag08_hierarchy", f"{_YEARLY} {levels_sql('yr, sum(qty) AS qty, count(*) AS n')}")
def ag08(spark, sf_dir):
    s = sales(spark, sf_dir).withColumn("yr", F.year("d").cast("long"))
    return H.rollup(s, H.LEVELS, ["yr"], {"qty": F.col("qty"), "n": F.lit(1)})


@_simple("ag09_mean_price_hierarchy", f"{_YEARLY} {levels_sql('round(avg(price / qty), 8) AS price')}")
def ag09(spark, sf_dir):
    price = F.col("price") / F.col("qty")
    sums = H.rollup(sales(spark, sf_dir), H.LEVELS, [], {"s": price, "n": F.when(price.isNotNull(), 1).otherwise(0)})
    return sums.select("level", "group_id", r(F.try_divide("s", "n"), 8).alias("price"))


@_simple("ag10_functional_dependency", "SELECT (SELECT max(c) <= 1 FROM (SELECT count(DISTINCT n_regionkey) AS c FROM nation GROUP BY n_nationkey)) AS nation_region, (SELECT max(c) <= 1 FROM (SELECT count(DISTINCT p_type) AS c FROM part GROUP BY p_brand)) AS brand_type")
def ag10(spark, sf_dir):
    a = H.depends(t(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey").withColumnRenamed("holds", "nation_region")
    return a.crossJoin(H.depends(t(spark, sf_dir, "part"), "p_brand", "p_type").withColumnRenamed("holds", "brand_type"))


@_simple("ag11_quantiles", "SELECT l_suppkey, round(quantile_cont(l_quantity, 0.1), 6) AS q10, round(quantile_cont(l_quantity, 0.5), 6) AS q50, round(quantile_cont(l_quantity, 0.9), 6) AS q90 FROM lineitem GROUP BY l_suppkey")
def ag11(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[r(F.percentile("l_quantity", q)).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9)])


_NINE = (0.005, 0.025, 0.165, 0.25, 0.5, 0.75, 0.835, 0.975, 0.995)


@_simple("ag12_nine_quantiles", f"WITH {BRAND} SELECT id, " + ", ".join(f"round(quantile_cont(y, {q}), 6) AS q{k}" for k, q in enumerate(_NINE)) + " FROM panel0 GROUP BY id")
def ag12(spark, sf_dir):
    qs = brand_panel(spark, sf_dir, True).groupBy("id").agg(F.percentile("y", F.array(*map(F.lit, _NINE))).alias("q"))
    return qs.select("id", *[r(F.col("q")[k]).alias(f"q{k}") for k in range(9)])


@_simple("ag13_weighted_mean", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS m FROM lineitem GROUP BY l_suppkey")
def ag13(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r(M.weighted_mean("l_discount", "l_quantity"), 8).alias("m"))


@_simple("ag14_share_of_total", "SELECT p_type, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM part GROUP BY p_type")
def ag14(spark, sf_dir):
    n = t(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("total"))).select("p_type", r(F.col("n") / F.col("total"), 8).alias("share"))


@_simple("ag15_effect_chooser", f"WITH {BRAND}, e AS (SELECT id, month(d) AS m, avg(y) AS a, quantile_cont(y, 0.5) AS q FROM panel0 GROUP BY ALL) SELECT id, m, round(CASE WHEN abs(a - 1) <= abs(q - 1) THEN a ELSE q END, 6) AS eff FROM e")
def ag15(spark, sf_dir):
    e = brand_panel(spark, sf_dir, True).groupBy("id", F.month("d").cast("long").alias("m")).agg(F.avg("y").alias("a"), F.percentile("y", 0.5).alias("q"))
    return e.select("id", "m", r(F.when(F.abs(F.col("a") - 1) <= F.abs(F.col("q") - 1), F.col("a")).otherwise(F.col("q"))).alias("eff"))


@_simple("ag16_row_wise", "SELECT l_orderkey, l_linenumber, round(l_discount + l_tax + l_quantity, 6) AS s, least(l_discount, l_tax) AS lo, CASE WHEN l_discount <= l_tax THEN 'l_discount' ELSE 'l_tax' END AS at FROM lineitem")
def ag16(spark, sf_dir):
    xs = F.array("l_discount", "l_tax", "l_quantity")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)).alias("s"), F.least("l_discount", "l_tax").alias("lo"), F.when(F.col("l_discount") <= F.col("l_tax"), "l_discount").otherwise("l_tax").alias("at"))


@_simple("ag17_trend_correlation", f"WITH {BRAND}, s AS (SELECT id, y, row_number() OVER (PARTITION BY id ORDER BY d) AS i FROM panel0) SELECT id, round(coalesce(corr(y, i), 0), 6) AS trend FROM s GROUP BY id")
def ag17(spark, sf_dir):
    s = brand_panel(spark, sf_dir, True).withColumn("i", F.row_number().over(W.ordered(["id"], "d")).cast("double"))
    return s.groupBy("id").agg(r(F.coalesce(F.corr("y", "i"), F.lit(0.0))).alias("trend"))


@_simple("ag18_autocorrelation", f"WITH {BRAND}, s AS (SELECT id, y, lag(y, 7) OVER (PARTITION BY id ORDER BY d) AS z FROM panel0) SELECT id, round(corr(y, z), 6) AS ac7 FROM s WHERE z IS NOT NULL GROUP BY id")
def ag18(spark, sf_dir):
    s = brand_panel(spark, sf_dir, True).withColumn("z", F.lag("y", 7).over(W.ordered(["id"], "d")))
    return s.where("z is not null").groupBy("id").agg(r(F.corr("y", "z")).alias("ac7"))


@_simple("ag19_dataset_statistics", f"WITH {BRAND} SELECT count(*) AS n, count(DISTINCT id) AS series, min(y) AS lo, max(y) AS hi, round(avg(y), 6) AS mean, count(*) - count(y) AS missing FROM panel")
def ag19(spark, sf_dir):
    return brand_panel(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("id").alias("series"), F.min("y").alias("lo"), F.max("y").alias("hi"), r(F.avg("y")).alias("mean"), (F.count("*") - F.count("y")).alias("missing"))


@_simple("ag20_closing_days", f"WITH {BRAND} SELECT d, sum(y) AS total, sum(y) < 50 AS closed FROM panel0 GROUP BY d")
def ag20(spark, sf_dir):
    return brand_panel(spark, sf_dir, True).groupBy("d").agg(F.sum("y").alias("total"), (F.sum("y") < 50).alias("closed"))


@_simple("ag21_calibration_factor", f"WITH {BRAND}, s AS (SELECT id, d, y, lag(y, 28) OVER (PARTITION BY id ORDER BY d) AS f FROM panel0) SELECT id, round(avg(y) / nullif(avg(f), 0), 6) AS factor FROM s WHERE d >= DATE '2000-01-01' AND f IS NOT NULL GROUP BY id")
def ag21(spark, sf_dir):
    s = brand_panel(spark, sf_dir, True).withColumn("f", F.lag("y", 28).over(W.ordered(["id"], "d")))
    return s.where("d >= '2000-01-01' and f is not null").groupBy("id").agg(r(F.try_divide(F.avg("y"), F.avg("f"))).alias("factor"))


@_simple("ag22_importance_summary", "SELECT event_type AS feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 5) AS std FROM events GROUP BY event_type")
def ag22(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature")).agg(r(F.avg("value")).alias("mean"), r(F.stddev_samp("value"), 5).alias("std"))


@_simple("ag23_resample", "SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL")
def ag23(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))


@_simple("ag24_null_keys_dropped", f"WITH {BRAND} SELECT y, count(*) AS n FROM panel WHERE y IS NOT NULL GROUP BY y")
def ag24(spark, sf_dir):
    return brand_panel(spark, sf_dir).where("y is not null").groupBy("y").agg(F.count("*").alias("n"))


@_simple("ag25_median_normaliser", f"WITH {BRAND}, m AS (SELECT id, quantile_cont(y, 0.5) AS q FROM panel0 GROUP BY id) SELECT id, d, round(y / CASE WHEN q = 0 THEN 1 ELSE q END, 6) AS norm FROM panel0 JOIN m USING (id)")
def ag25(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True)
    m = p.groupBy("id").agg(F.percentile("y", 0.5).alias("q"))
    return p.join(m, "id").select("id", "d", r(F.col("y") / F.when(F.col("q") == 0, 1.0).otherwise(F.col("q"))).alias("norm"))


@_simple("ag26_level_weight", f"WITH {SALES}, w AS (SELECT dept, sum(price) AS p FROM sales WHERE d > DATE '2001-08-01' GROUP BY dept), s AS (SELECT dept, p / sum(p) OVER () AS share FROM w) SELECT dept, round(share / avg(share) OVER (), 6) AS weight FROM s")
def ag26(spark, sf_dir):
    w = sales(spark, sf_dir).where("d > '2001-08-01'").groupBy("dept").agg(F.sum("price").alias("p"))
    total = w.agg(F.sum("p").alias("total"), F.count("*").alias("k"))
    return w.crossJoin(total).select("dept", r(F.col("p") / F.col("total") * F.col("k")).alias("weight"))


def _coded_sql() -> str:
    codes = [f"c_{k} AS (SELECT {k} AS v, dense_rank() OVER (ORDER BY {k}) - 1 AS code FROM (SELECT DISTINCT {k} FROM sales))" for k in H.DIMENSIONS]
    parts = []
    for level in H.LEVELS:
        columns = [f"c_{k}.code AS {k}_code" if k in level else f"(SELECT count(*) FROM c_{k}) AS {k}_code" for k in H.DIMENSIONS]
        joins = "".join(f" JOIN c_{k} ON c_{k}.v = s.{k}" for k in level)
        parts.append(f"SELECT '{H.level_name(level)}' AS level, {', '.join(columns)}, sum(qty) AS qty FROM sales s{joins} GROUP BY ALL")
    return f"WITH {SALES}, {', '.join(codes)} " + " UNION ALL ".join(parts)


@_simple("ag27_codes_at_levels", _coded_sql())
def ag27(spark, sf_dir):
    """Every level's sums under integer codes; a key that a level doesn't have gets the number of its codes ("all")."""
    bottom = checkpoint(sales(spark, sf_dir).groupBy(*H.DIMENSIONS).agg(F.sum("qty").alias("qty")), "coded")
    codes = {k: S.dense_codes(bottom.select(k), k, f"{k}_code") for k in H.DIMENSIONS}
    sizes, out = {k: c.count() for k, c in codes.items()}, []
    for level, frame in H.level_sums(bottom, H.LEVELS, [], {"qty": F.col("qty")}, summed=True).items():
        for k in level:
            frame = frame.join(codes[k], k)
        out.append(frame.select(F.lit(H.level_name(level)).alias("level"), *[F.col(f"{k}_code") if k in level else F.lit(sizes[k]).cast("long").alias(f"{k}_code") for k in H.DIMENSIONS], "qty"))
    return reduce(DataFrame.unionByName, out)


@_simple("o01_multi_key_sort", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey, n_name")
def o01(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_name", "n_regionkey").orderBy("n_regionkey", "n_name")


@_simple("o02_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def o02(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(25)


@_simple("o03_head_tail", "(SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def o03(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey")
    return o.orderBy("o_orderkey").limit(5).unionByName(o.orderBy(F.col("o_orderkey").desc()).limit(5))


@_simple("o04_sorted_array", "SELECT user_id, array_to_string(list_sort(list(CAST(event_id AS BIGINT))), ',') AS ids FROM events GROUP BY user_id")
def o04(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_id")).cast("array<string>"), ",").alias("ids"))


@_simple("o05_external_order", f"WITH {EVENTS} SELECT v.pos, v.id, sum(n)::BIGINT AS n FROM (VALUES (1, 'view'), (2, 'click'), (3, 'other')) v(pos, id) LEFT JOIN ev USING (id) GROUP BY ALL")
def o05(spark, sf_dir):
    ids = spark.createDataFrame([(1, "view"), (2, "click"), (3, "other")], "pos int, id string")
    return ids.join(events_daily(spark, sf_dir).groupBy("id").agg(F.sum("n").alias("n")), "id", "left").select("pos", "id", "n")


def _draw(seed: str, *keys: str):
    """A uniform number below 2^48 from the hash of a seed and keys, and the same in SQL."""
    return F.conv(F.substring(F.sha2(F.concat_ws("-", F.lit(seed), *[F.col(k).cast("string") for k in keys]), 256), 1, 12), 16, 10).cast("long")


def _draw_sql(seed: str, *keys: str) -> str:
    return f"('0x' || substr(sha256(concat_ws('-', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 12))::BIGINT"


@_simple("o06_shuffle_rows", f"SELECT c_custkey, {_draw_sql('shuffle', 'c_custkey')} AS place FROM customer ORDER BY place")
def o06(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", _draw("shuffle", "c_custkey").alias("place")).orderBy("place", "c_custkey")


_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"


@_simple(
    "o07_weighted_sample",
    f"WITH c AS (SELECT p_partkey, {_CENTS} AS w, sum({_CENTS}) OVER (ORDER BY p_partkey % 64, p_partkey) AS hi FROM part), k AS (SELECT CAST(k AS BIGINT) AS k FROM range(100) r(k)), "
    f"u AS (SELECT k, {_draw_sql('weighted', 'k')} % (SELECT max(hi) FROM c) AS u FROM k) SELECT k, p_partkey FROM u JOIN c ON u >= hi - w AND u < hi",
)
def o07(spark, sf_dir):
    """A hundred draws with replacement, by weight: the inverse of the cumulative weights, which are summed by bucket first."""
    w = t(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("w"))
    draws = spark.range(100).select(F.col("id").alias("k"), _draw("weighted", "id").alias("u"))
    return sampling.draw_by_weight(w, "p_partkey", "w", draws).select("k", "p_partkey")


@_simple(
    "o08_oversample",
    f"WITH {BRAND}, w AS (SELECT id, d, y, least(CAST(y AS BIGINT) * 10, 3000) AS w, {_draw_sql('over', 'id', 'd')} % 1000 AS u FROM daily) "
    "SELECT id, d, y, CAST(unnest(range(1, greatest(w // 1000 + CASE WHEN u < w % 1000 THEN 1 ELSE 0 END, 1) + 1)) AS BIGINT) AS copy FROM w",
)
def o08(spark, sf_dir):
    d = brand_daily(spark, sf_dir).withColumn("w", F.least(F.col("y").cast("long") * 10, F.lit(3000).cast("long")))
    copies = F.floor(F.col("w") / 1000) + F.when(_draw("over", "id", "d") % 1000 < F.col("w") % 1000, 1).otherwise(0)
    return d.select("id", "d", "y", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(copies, F.lit(1)).cast("long"))).alias("copy"))


@_simple(
    "o08_oversample_unbounded",
    f"WITH {BRAND}, w AS (SELECT id, d, y, CAST(y AS BIGINT) * 10 AS w, {_draw_sql('over', 'id', 'd')} % 1000 AS u FROM daily) "
    "SELECT id, d, y, CAST(unnest(range(1, greatest(w // 1000 + CASE WHEN u < w % 1000 THEN 1 ELSE 0 END, 1) + 1)) AS BIGINT) AS copy FROM w",
)
def o08_unbounded(spark, sf_dir):
    """As o08_oversample without its limit: a day of any weight has its whole number of copies, and one more with the probability of the rest."""
    d = brand_daily(spark, sf_dir).withColumn("w", F.col("y").cast("long") * 10)
    copies = F.floor(F.col("w") / 1000) + F.when(_draw("over", "id", "d") % 1000 < F.col("w") % 1000, 1).otherwise(0)
    return d.select("id", "d", "y", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(copies, F.lit(1)).cast("long"))).alias("copy"))


_LENGTHS = "WITH n AS (SELECT p_partkey AS id, count(l_orderkey) AS n FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1), m AS (SELECT max(n) AS most FROM n)"


@_simple("o08_balanced_lengths", f"{_LENGTHS} SELECT id, n, most // n + CASE WHEN {_draw_sql('length', 'id')} % n < most % n THEN 1 ELSE 0 END AS copies FROM n, m")
def o08_lengths(spark, sf_dir):
    """How often each series is taken so that short ones give as many rows as the longest, in the mean."""
    n = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n")).join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "id")
    both = n.crossJoin(n.agg(F.max("n").alias("most")))
    return both.select("id", "n", (F.floor(F.col("most") / F.col("n")) + F.when(_draw("length", "id") % F.col("n") < F.col("most") % F.col("n"), 1).otherwise(0)).cast("long").alias("copies"))


@_simple("o09_hash_downsample", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (('0x' || substr(sha256(CAST(l_orderkey AS VARCHAR)), 1, 8))::BIGINT) % 2 = 0")
def o09(spark, sf_dir):
    even = F.conv(F.substring(F.sha2(F.col("l_orderkey").cast("string"), 256), 1, 8), 16, 10).cast("long") % 2 == 0
    return t(spark, sf_dir, "lineitem").where(even).select("l_orderkey", "l_linenumber")


@_simple("o10_row_sample", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_draw_sql('row', 'l_orderkey', 'l_linenumber')} % 10 = 0")
def o10(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").where(_draw("row", "l_orderkey", "l_linenumber") % 10 == 0).select("l_orderkey", "l_linenumber")


@_simple("o11_instance_sampler", f"WITH {BRAND} SELECT id, d, y FROM panel0 WHERE {_draw_sql('point', 'id', 'd')} % 1000 < 10")
def o11(spark, sf_dir):
    return brand_panel(spark, sf_dir, True).where(_draw("point", "id", "d") % 1000 < 10)


@_simple("o11_expected_count", f"WITH {BRAND}, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM daily) SELECT id, d, y FROM n WHERE {_draw_sql('expected', 'id', 'd')} % n < 5")
def o11_expected(spark, sf_dir):
    """Five points of each series in the mean, whatever its length."""
    n = brand_daily(spark, sf_dir).withColumn("n", F.count("*").over(W.by("id")))
    return n.where(_draw("expected", "id", "d") % F.col("n") < 5).select("id", "d", "y")


@_simple(
    "o11_bucket_sampler",
    f"WITH {BRAND}, b AS (SELECT *, CAST(floor(ln(y + 1)) AS BIGINT) AS bucket FROM daily), n AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS n FROM b) SELECT id, d, y, bucket FROM n WHERE {_draw_sql('bucket', 'id', 'd')} % n < 20",
)
def o11_bucket(spark, sf_dir):
    """Points of all scales alike: of each bucket of the logarithm of the scale twenty in the mean. Sizes are counted apart, so a large bucket isn't one task."""
    b = brand_daily(spark, sf_dir).withColumn("bucket", F.floor(F.log(F.col("y") + 1)).cast("long"))
    return b.join(b.groupBy("bucket").agg(F.count("*").alias("n")), "bucket").where(_draw("bucket", "id", "d") % F.col("n") < 20).select("id", "d", "y", "bucket")


@_simple("so1_union_by_name", "SELECT s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def so1(spark, sf_dir):
    a = t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")), allowMissingColumns=True)


@_simple("so2_union_with_tag", f"WITH {BRAND} SELECT id, d, y, 'actual' AS model FROM panel0 UNION ALL SELECT id, d, lag(y, 7) OVER (PARTITION BY id ORDER BY d), 'lag_7' FROM panel0")
def so2(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True)
    return p.withColumn("model", F.lit("actual")).unionByName(p.select("id", "d", F.lag("y", 7).over(W.ordered(["id"], "d")).alias("y"), F.lit("lag_7").alias("model")))


@_simple("so3_mirror_rows", "SELECT 'x' || s_suppkey || '_validation' AS id FROM supplier UNION ALL SELECT 'x' || s_suppkey || '_evaluation' FROM supplier")
def so3(spark, sf_dir):
    v = t(spark, sf_dir, "supplier").select(F.concat(F.lit("x"), F.col("s_suppkey").cast("string"), F.lit("_validation")).alias("id"))
    return v.unionByName(v.select(F.regexp_replace("id", "validation$", "evaluation").alias("id")))


@_simple("so4_horizon_augmentation", f"WITH {EVENTS} SELECT id, d, n, h, CAST(d - CAST(h AS INTEGER) AS DATE) AS date_from FROM ev, (SELECT k::INTEGER AS h FROM range(1, 29) x(k)) WHERE (dayofyear(d) + h) % 4 = 0")
def so4(spark, sf_dir):
    e = events_daily(spark, sf_dir).select("id", "d", "n", F.explode(F.sequence(F.lit(1), F.lit(28))).alias("h"))
    return e.where((F.dayofyear("d") + F.col("h")) % 4 == 0).withColumn("date_from", F.date_sub("d", F.col("h")))


@_simple("so5_union_distinct", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def so5(spark, sf_dir):
    return t(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(t(spark, sf_dir, "region").select("r_name")).distinct()


@_simple("so6_difference_intersection", "SELECT k, 'minus' AS op FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 25) UNION ALL SELECT k, 'and' FROM (SELECT p_partkey AS k FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 25)")
def so6(spark, sf_dir):
    a, b = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), t(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("k"))
    return a.subtract(b).withColumn("op", F.lit("minus")).unionByName(a.intersect(b).withColumn("op", F.lit("and")))


@_simple("so7_shared_columns", "SELECT s_nationkey AS nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def so7(spark, sf_dir):
    a = t(spark, sf_dir, "supplier").toDF(*[c[2:] for c in t(spark, sf_dir, "supplier").columns]).select("nationkey", "suppkey")
    b = t(spark, sf_dir, "customer").toDF(*[c[2:] for c in t(spark, sf_dir, "customer").columns]).select("nationkey", "custkey")
    shared = [c for c in a.columns if c in set(b.columns)]
    return a.select(*shared).unionByName(b.select(*shared))
