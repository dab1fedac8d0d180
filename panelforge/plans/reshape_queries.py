"""Queries S1 to S18 (sources and sinks) and P1 to P35 (projection, filter, reshape)."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.operators import panel
from panelforge.operators import windows as W
from panelforge.plans.base import BRAND, EVENTS, brand_daily, brand_panel, events_daily, r, t
from panelforge.plans.registry import register
from panelforge.session import shared_path
from panelforge.operators import reshape
from panelforge.sources import files, jsonl, recipes

NATION = "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation"


files.DATASETS.update(events_daily=events_daily, brand_panel=brand_panel)


@register("s01_csv_scan", NATION)
def s01(spark, sf_dir):
    path = shared_path(spark, "csv")
    files.write_csv(t(spark, sf_dir, "nation"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@register("s02_csv_projection", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 10")
def s02(spark, sf_dir):
    path = shared_path(spark, "csv")
    files.write_csv(t(spark, sf_dir, "nation"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int").orderBy("n_nationkey").limit(10).select("n_name")


@register("s03_csv_dates", "SELECT event_id, CAST(ts AS DATE) AS d FROM events")
def s03(spark, sf_dir):
    path = shared_path(spark, "csv")
    files.write_csv(t(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd.MM.yyyy").alias("d")), path)
    return files.read_csv(spark, path, "event_id long, d date", dateFormat="dd.MM.yyyy")


@register("s04_mixed_date_formats", "SELECT event_id, CAST(ts AS DATE) AS d FROM events")
def s04(spark, sf_dir):
    odd = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd-MM-yy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    text = t(spark, sf_dir, "events").select("event_id", odd.alias("s"))
    return text.select("event_id", files.parse_date("s", ["yyyy-MM-dd", "dd-MM-yy"]).alias("d"))


@register("s05_tagged_multi_file_scan", "SELECT event_id, event_type AS tag FROM events")
def s05(spark, sf_dir):
    """One folder for each event type of the table, all written in one pass and read by one scan."""
    source, root = t(spark, sf_dir, "events").select("event_id", "event_type"), shared_path(spark, "tags")
    source.write.partitionBy("event_type").parquet(root)
    return files.read_tagged(spark, root, "event_type").withColumnRenamed("event_type", "tag")


@register("s06_glob_concat", "SELECT r_regionkey, r_name FROM region")
def s06(spark, sf_dir):
    root = shared_path(spark, "glob")
    for k in range(3):
        t(spark, sf_dir, "region").where(F.col("r_regionkey") % 3 == k).write.csv(f"{root}/part={k}", header=True)
    return files.read_csv(spark, f"{root}/*", "r_regionkey int, r_name string")


@register("s07_parquet_projection", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def s07(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_quantity")


@register("s08_checkpoint", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def s08(spark, sf_dir):
    return files.checkpoint(t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")), "counts")


@register("s09_feature_store", f"WITH {BRAND} SELECT id, d, y, lag(y, 7) OVER (PARTITION BY id ORDER BY d) AS lag_7 FROM panel0")
def s09(spark, sf_dir):
    p = brand_panel(spark, sf_dir, True)
    return files.checkpoint(p.select("id", "d", "y", F.lag("y", 7).over(W.ordered(["id"], "d")).alias("lag_7"), (F.col("y") * 2).alias("unused")), "features").select("id", "d", "y", "lag_7")


@register("s10_json_lines", "SELECT s_suppkey, s_name FROM supplier")
def s10(spark, sf_dir):
    path = shared_path(spark, "jsonl")
    t(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.json(path)
    return files.read_json_lines(spark, path, "s_suppkey long, s_name string")


@register("s10_json_lines_with_place", "SELECT CASE WHEN s_suppkey % 10 <> 3 THEN s_suppkey END AS s_suppkey, CASE WHEN s_suppkey % 10 <> 3 THEN s_name END AS s_name, CASE WHEN s_suppkey % 10 = 3 THEN 12 ELSE strlen('{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\"}') END AS bytes, s_suppkey % 10 = 3 AS bad FROM supplier")
def s10_place(spark, sf_dir):
    """Every tenth line is cut short; the reader gives it its place instead of values, from files that are split into byte ranges."""
    path = shared_path(spark, "jsonl")
    line = F.to_json(F.struct("s_suppkey", "s_name"))
    t(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 10 == 3, F.substring(line, 1, 12)).otherwise(line)).write.text(path)
    rows = jsonl.read_json_lines(spark, path, "s_suppkey long, s_name string", bad="keep", split_bytes=1 << 16)
    return rows.select("s_suppkey", "s_name", (F.col("end") - F.col("start")).alias("bytes"), F.col("error").isNotNull().alias("bad"))


@register("s11_dataset_directory", f"WITH {BRAND} SELECT id, count(*) AS n, sum(y) AS total FROM panel0 GROUP BY id")
def s11(spark, sf_dir):
    root = shared_path(spark, "dataset")
    files.save_dataset(brand_panel(spark, sf_dir, True), ["id"], "d", "y", root)
    items = files.read_dataset(spark, f"{root}/train")
    return items.select("id", F.size("target").cast("long").alias("n"), F.aggregate("target", F.lit(0.0), lambda a, x: a + x).alias("total"))


@register("s12_in_memory_dataset", "SELECT * FROM (VALUES ('a', DATE '2024-01-01', 6.0), ('b', DATE '2024-01-03', 9.0)) v(item, start, total)")
def s12(spark, sf_dir):
    items = files.list_dataset(spark, [("a", "2024-01-01", [1.0, 2.0, 3.0]), ("b", "2024-01-03", [4.0, 5.0])])
    return items.select("item", "start", F.aggregate("target", F.lit(0.0), lambda a, x: a + x).alias("total"))


@register("s13_dataset_save", f"WITH {BRAND} SELECT id, min(d) AS start, CAST(sum(y) AS BIGINT) AS total FROM panel0 GROUP BY id")
def s13(spark, sf_dir):
    root = shared_path(spark, "dataset")
    files.save_dataset(brand_panel(spark, sf_dir, True), ["id"], "d", "y", root)
    items = files.read_dataset(spark, f"{root}/train")
    return items.select("id", "start", F.aggregate("target", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"))


@register("s14_dataset_registry", f"WITH {EVENTS} SELECT id, count(*) AS n FROM ev GROUP BY id")
def s14(spark, sf_dir):
    return files.dataset(spark, sf_dir, "events_daily").groupBy("id").agg(F.count("*").alias("n"))


@register("s15_synthetic_series", "SELECT i AS id, CAST(k AS BIGINT) AS step, round(10 + 0.5 * k + 3 * sin(2 * pi() * k / 7), 6) AS y FROM range(5) a(i), range(60) b(k)")
def s15(spark, sf_dir):
    return files.synthetic(spark, 5, 60, level=10.0, trend=0.5, season=7, amplitude=3.0, noise=0.0)


def _u(name: str, at: str = "step") -> str:
    return f"((('0x' || substr(sha256('11:{name}:' || id || ':' || {at}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _n(name: str, at: str = "step") -> str:
    return f"(sqrt(-2 * ln({_u(name + '/r', at)})) * cos(2 * pi() * {_u(name + '/a', at)}))"


@register(
    "s15_recipe",
    f"""WITH RECURSIVE g AS (SELECT p_brand AS id, CAST(k AS BIGINT) AS step FROM (SELECT DISTINCT p_brand FROM part), range(100) x(k)),
a AS (SELECT id, step, 5 + 0.1::DOUBLE * step AS base, 3 * sin(2 * pi() * step / 7) AS week, {_u('promo/0/0')} AS u, CASE WHEN {_u('level/0/0')} < 0.05::DOUBLE THEN 1 ELSE 0 END AS ch, {_n('noise')} * 0.5::DOUBLE AS noise, 0.5::DOUBLE + {_u('scale', "'series'")} AS scale, CASE WHEN {_u('y/1')} < 0.1::DOUBLE THEN 1 ELSE 0 END AS gone FROM g),
m AS (SELECT id, -1::BIGINT AS step, 0 AS promo FROM (SELECT DISTINCT id FROM g) UNION ALL SELECT m.id, a.step, CASE WHEN m.promo = 0 THEN CASE WHEN u < 0.2::DOUBLE THEN 1 ELSE 0 END ELSE CASE WHEN u < 0.5::DOUBLE THEN 0 ELSE 1 END END FROM m JOIN a ON a.id = m.id AND a.step = m.step + 1),
b AS (SELECT a.*, promo, sum(ch) OVER (PARTITION BY a.id ORDER BY a.step ROWS UNBOUNDED PRECEDING) AS c FROM a JOIN m USING (id, step)),
c AS (SELECT *, {_n('level', 'CAST(c AS BIGINT)')} * 2 AS level FROM b),
d AS (SELECT *, (base + week + 4 * promo + level + noise) * scale AS clean FROM c)
SELECT id, step, CAST(promo AS DOUBLE) AS promo, round(level, 6) AS level, round(clean, 6) AS clean, CASE WHEN gone = 0 THEN round(clean + 0.5::DOUBLE * coalesce(lag(clean, 2) OVER (PARTITION BY id ORDER BY step), 0), 6) END AS y FROM d""",
)
def s15_recipe(spark, sf_dir):
    """A series for each brand of the table: trend, week, promotions that come and go, a level that jumps, noise, a scale of its own, an echo and gaps."""
    R = recipes
    recipe = {
        "base": R.trend(0.1, 5.0), "week": R.seasonality(7, 3.0), "promo": R.markov_chain(0.2, 0.5), "level": R.change_points(0.05, 2.0), "noise": R.gaussian(0.5), "scale": R.per_series(0.5, 1.5),
        "clean": (R.ref("base") + R.ref("week") + 4 * R.ref("promo") + R.ref("level") + R.ref("noise")) * R.ref("scale"),
        "y": R.missing_where(R.ref("clean") + 0.5 * R.lag(R.ref("clean"), 2), R.binary(0.1)),
    }
    out = R.generate(t(spark, sf_dir, "part"), "p_brand", 100, recipe, seed=11)
    return out.select("id", "step", "promo", *[r(c).alias(c) for c in ("level", "clean", "y")])


@register("s16_csv_rounded_sink", "SELECT o_orderkey, round(o_totalprice, 1) AS price FROM orders")
def s16(spark, sf_dir):
    path = shared_path(spark, "csv")
    files.write_csv(t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), path, digits=1)
    return files.read_csv(spark, path, "o_orderkey long, price double")


@register("s17_csv_gzip", NATION)
def s17(spark, sf_dir):
    path = shared_path(spark, "csv")
    files.write_csv(t(spark, sf_dir, "nation"), path, compression="gzip")
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@register("s18_json_settings", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY ALL")
def s18(spark, sf_dir):
    settings = json.loads('{"column": "l_quantity", "least": 30, "key": "l_returnflag"}')
    return t(spark, sf_dir, "lineitem").where(F.col(settings["column"]) > settings["least"]).groupBy(settings["key"]).agg(F.count("*").alias("n"))


WIDE = ["a", "b", "c"]
_WIDE_SQL = "wide AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 2.0 END AS b, p_retailprice AS c FROM part)"


def _wide(spark, sf_dir):
    size = F.col("p_size")
    return t(spark, sf_dir, "part").select("p_partkey", size.cast("double").alias("a"), F.when(size % 3 != 0, size * 2.0).alias("b"), F.col("p_retailprice").alias("c"))


_LONG = "SELECT p_partkey, 'a' AS d, a AS y FROM wide UNION ALL SELECT p_partkey, 'b', b FROM wide UNION ALL SELECT p_partkey, 'c', c FROM wide"


@register("p01_unpivot", f"WITH {_WIDE_SQL} SELECT * FROM ({_LONG}) WHERE y IS NOT NULL")
def p01(spark, sf_dir):
    return _wide(spark, sf_dir).unpivot("p_partkey", WIDE, "d", "y").where("y is not null")


@register("p02_melt_flags", "SELECT d, split_part(k, '_', 2) AS state, f FROM (SELECT d, 'snap_CA' AS k, CAST(day(d) % 2 = 0 AS INTEGER) AS f FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) UNION ALL SELECT d, 'snap_TX', CAST(day(d) % 3 = 0 AS INTEGER) FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events))")
def p02(spark, sf_dir):
    days = t(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct().select("d", (F.day("d") % 2 == 0).cast("int").alias("snap_CA"), (F.day("d") % 3 == 0).cast("int").alias("snap_TX"))
    return days.unpivot("d", ["snap_CA", "snap_TX"], "k", "f").select("d", F.element_at(F.split("k", "_"), 2).alias("state"), "f")


KINDS = ["click", "error", "purchase", "signup", "view"]


@register("p03_pivot", f"WITH {EVENTS} SELECT d, " + ", ".join(f"max(CASE WHEN id = '{k}' THEN n END) AS {k}" for k in KINDS) + " FROM ev GROUP BY d")
def p03(spark, sf_dir):
    return events_daily(spark, sf_dir).groupBy("d").pivot("id", KINDS).agg(F.first("n"))


@register("p04_pivot_mean", "SELECT user_id, " + ", ".join(f"round(avg(CASE WHEN event_type = '{k}' THEN value END), 6) AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def p04(spark, sf_dir):
    wide = t(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", KINDS).agg(F.avg("value"))
    return wide.select("user_id", *[r(k).alias(k) for k in KINDS])


@register("p05_unstack_by_position", f"WITH {EVENTS}, s AS (SELECT id, n, row_number() OVER (PARTITION BY id ORDER BY d) AS i FROM ev) SELECT id, max(CASE WHEN i = 1 THEN n END) AS F1, max(CASE WHEN i = 2 THEN n END) AS F2, max(CASE WHEN i = 3 THEN n END) AS F3 FROM s GROUP BY id")
def p05(spark, sf_dir):
    s = events_daily(spark, sf_dir).withColumn("i", F.concat(F.lit("F"), F.row_number().over(W.ordered(["id"], "d"))))
    return s.groupBy("id").pivot("i", ["F1", "F2", "F3"]).agg(F.first("n"))


@register("p05_unstack_all_positions", f"WITH {EVENTS}, s AS (SELECT id, n, 'F' || row_number() OVER (PARTITION BY id ORDER BY d) AS f FROM ev) SELECT * FROM (PIVOT s ON f USING max(n) GROUP BY id)")
def p05_all(spark, sf_dir):
    """A column for each position that any series has: as many as the longest series has days."""
    return reshape.unstack(events_daily(spark, sf_dir), ["id"], "d", "n")


@register("p06_stack_with_nulls", f"WITH {_WIDE_SQL} {_LONG}")
def p06(spark, sf_dir):
    return _wide(spark, sf_dir).unpivot("p_partkey", WIDE, "d", "y")


@register("p07_future_rows", f"WITH {BRAND} SELECT id, CAST(hi + CAST(k AS INTEGER) AS DATE) AS d, CAST(NULL AS DOUBLE) AS y FROM ids, bounds, range(1, 29) h(k)")
def p07(spark, sf_dir):
    return panel.future_rows(brand_daily(spark, sf_dir), ["id"], "d", 28).withColumn("y", F.lit(None).cast("double"))


@register("p08_wide_scaffold", f"WITH {_WIDE_SQL} SELECT p_partkey, 'd_1' AS d, a AS y FROM wide UNION ALL SELECT p_partkey, 'd_2', NULL FROM wide")
def p08(spark, sf_dir):
    return _wide(spark, sf_dir).select("p_partkey", F.col("a").alias("d_1"), F.lit(None).cast("double").alias("d_2")).unpivot("p_partkey", ["d_1", "d_2"], "d", "y")


@register("p09_computed_column", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 9) AS charge FROM lineitem")
def p09(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 9).alias("charge"))


@register("p10_template_columns", "SELECT p_partkey, " + ", ".join(f"p_size * {k} AS size_x{k}" for k in (2, 3, 5)) + " FROM part")
def p10(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", *[(F.col("p_size") * k).alias(f"size_x{k}") for k in (2, 3, 5)])


@register("p11_boolean_filter", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000 OR o_orderpriority LIKE '1%') AND NOT o_orderstatus = 'F'")
def p11(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.where(((F.col("o_totalprice") > 100000) | F.col("o_orderpriority").startswith("1")) & ~(F.col("o_orderstatus") == "F")).select("o_orderkey")


@register("p12_query_string", "SELECT s_suppkey, 1 AS k FROM supplier WHERE s_acctbal > 0")
def p12(spark, sf_dir):
    return t(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey", "1 AS k")


@register("p13_membership", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def p13(spark, sf_dir):
    return t(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey")


@register("p14_string_predicate", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[12]') AND contains(p_name, 'a') AND starts_with(p_type, upper(substr(p_type, 1, 1)))")
def p14(spark, sf_dir):
    return t(spark, sf_dir, "part").where(F.col("p_brand").rlike("#[12]") & F.col("p_name").contains("a") & F.col("p_type").startswith(F.upper(F.substring("p_type", 1, 1)))).select("p_partkey")


@register("p15_conditional", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS k FROM part")
def p15(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("k"))


@register("p16_masked_update", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END AS qty FROM lineitem")
def p16(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("qty"))


@register("p17_null_fill", f"WITH {_WIDE_SQL} SELECT p_partkey, coalesce(b, a, 0.0) AS b FROM wide")
def p17(spark, sf_dir):
    return _wide(spark, sf_dir).select("p_partkey", F.coalesce("b", "a", F.lit(0.0)).alias("b"))


@register("p18_row_back_fill", f"WITH {_WIDE_SQL} SELECT p_partkey, a, coalesce(b, c) AS b, c FROM wide")
def p18(spark, sf_dir):
    return _wide(spark, sf_dir).select("p_partkey", "a", F.coalesce("b", "c").alias("b"), "c")


@register("p19_forward_fill", f"WITH {BRAND} SELECT id, d, last_value(y IGNORE NULLS) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM panel")
def p19(spark, sf_dir):
    return brand_panel(spark, sf_dir).select("id", "d", W.forward_fill("y", W.ordered(["id"], "d")).alias("y"))


@register("p20_drop_nulls", f"WITH {_WIDE_SQL} SELECT * FROM wide WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def p20(spark, sf_dir):
    return _wide(spark, sf_dir).dropna("any")


@register("p21_replace_value", f"WITH {BRAND} SELECT id, d, nullif(y, 0) AS y_null, CASE WHEN y = 0 THEN 1.0 ELSE y END AS y_one FROM panel0")
def p21(spark, sf_dir):
    return brand_panel(spark, sf_dir, True).select("id", "d", F.nullif("y", F.lit(0.0)).alias("y_null"), F.when(F.col("y") == 0, 1.0).otherwise(F.col("y")).alias("y_one"))


@register("p22_clip", f"WITH {_WIDE_SQL} SELECT p_partkey, CASE WHEN b IS NOT NULL THEN least(greatest(b, 10.0), 60.0) END AS b FROM wide")
def p22(spark, sf_dir):
    return _wide(spark, sf_dir).select("p_partkey", panel.clip(F.col("b"), 10.0, 60.0).alias("b"))


@register("p23_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def p23(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@register("p24_first_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def p24(spark, sf_dir):
    return panel.first_by(t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@register("p25_strongest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def p25(spark, sf_dir):
    return panel.first_by(t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("p26_rename_drop", "SELECT r_regionkey AS key_left, r_name AS name_left FROM region")
def p26(spark, sf_dir):
    return t(spark, sf_dir, "region").withColumn("x", F.lit(1)).withColumnsRenamed({"r_regionkey": "key_left", "r_name": "name_left"}).drop("x")


@register("p27_select_by_type", "SELECT c_name, c_mktsegment FROM customer")
def p27(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    return c.select(*[name for name, kind in c.dtypes if kind == "string"])


@register("p28_transform_chain", "SELECT p_partkey, p_size + 1 AS s FROM part WHERE p_size + 1 > 20")
def p28(spark, sf_dir):
    return t(spark, sf_dir, "part").transform(lambda d: d.select("p_partkey", (F.col("p_size") + 1).alias("s"))).transform(lambda d: d.where("s > 20"))


@register("p29_field_ops", "SELECT s_suppkey AS item, coalesce(s_acctbal, 0.0) AS target, 'D' AS freq FROM supplier")
def p29(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "item", "s_acctbal": "target"}).drop("s_name", "s_nationkey")
    return s.withColumn("freq", F.lit("D")).withColumn("target", F.coalesce("target", F.lit(0.0))).select("item", "target", "freq")


@register("p30_array_ops", "SELECT p_partkey, CAST(p_size AS VARCHAR) || ',' || CAST(p_size * 2 AS VARCHAR) || ',' || CAST(p_size * 3 AS VARCHAR) AS xs, p_size * 6 AS total FROM part")
def p30(spark, sf_dir):
    xs = F.concat(F.array("p_size", F.col("p_size") * 2), F.array(F.col("p_size") * 3))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(xs, lambda x: x.cast("string")), ",").alias("xs"), F.aggregate(xs, F.lit(0), lambda a, x: a + x).alias("total"))


@register("p31_dimension_indicator", f"WITH {_WIDE_SQL} SELECT p_partkey, 0 AS dim, a AS y FROM wide UNION ALL SELECT p_partkey, 1, b FROM wide UNION ALL SELECT p_partkey, 2, c FROM wide")
def p31(spark, sf_dir):
    return _wide(spark, sf_dir).select("p_partkey", F.posexplode(F.array("a", "b", "c")).alias("dim", "y"))


@register("p32_positional_slice", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) > 500")
def p32(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey")
    head = o.orderBy("o_orderkey").limit(500)
    return o.join(head.agg(F.max("o_orderkey").alias("cut")), F.col("o_orderkey") > F.col("cut")).select("o_orderkey")


_PAIRS = list(combinations(WIDE, 2))


@register("p33_pairwise_crosses", f"WITH {_WIDE_SQL} SELECT p_partkey, " + ", ".join(f"{x} - {y} AS {x}_minus_{y}, round({x} / nullif({y}, 0), 8) AS {x}_by_{y}" for x, y in _PAIRS) + " FROM wide")
def p33(spark, sf_dir):
    return _wide(spark, sf_dir).select("p_partkey", *[c for x, y in _PAIRS for c in ((F.col(x) - F.col(y)).alias(f"{x}_minus_{y}"), r(F.try_divide(x, y), 8).alias(f"{x}_by_{y}"))])


@register("p34_drop_season", f"WITH {BRAND} SELECT id, d, y FROM panel0 WHERE year(d) > 1995 AND NOT (month(d) = 12 AND day(d) > 20)")
def p34(spark, sf_dir):
    return brand_panel(spark, sf_dir, True).where((F.year("d") > 1995) & ~((F.month("d") == 12) & (F.day("d") > 20)))


@register("p35_parameter_catalogue", "SELECT * FROM (VALUES ('a', 0.1, 31), ('b', 0.05, 63), ('c', 0.1, 127)) v(name, rate, leaves)")
def p35(spark, sf_dir):
    given = [("a", None, 31, None), ("b", 0.05, None, 63), ("c", None, None, 127)]
    return spark.createDataFrame(given, "name string, rate double, num_leaves int, max_leaves int").select("name", F.coalesce("rate", F.lit(0.1)).alias("rate"), F.coalesce("num_leaves", "max_leaves").alias("leaves"))
