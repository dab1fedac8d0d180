"""Frames and SQL fragments that the named queries share.

The retail panel is mapped to the star schema: item = part, dept = brand,
cat = type, store = supplier, state = nation / region, daily units =
sum(l_quantity). ``brand_panel`` is dense: every brand on every day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import hierarchy as H
from panelforge.operators import panel


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, dept, cat, store, region, nation, d, qty, price: one row for each line item, with its dimensions."""
    line = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("store"), F.to_date("l_shipdate").alias("d"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    part = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("dept"), F.col("p_type").alias("cat"))
    nation = t(spark, sf_dir, "nation").join(F.broadcast(t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    store = t(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("store"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return line.join(part, "item").join(store, "store")


SALES = """sales AS (
  SELECT l_partkey AS item, p_brand AS dept, p_type AS cat, l_suppkey AS store, n_name AS nation, r_name AS region, CAST(l_shipdate AS DATE) AS d, l_quantity AS qty, l_extendedprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def brand_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (brand), d, y: units of days with sales."""
    line = t(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("d"), "l_quantity")
    part = t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("id"))
    return line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy("id", "d").agg(F.sum("l_quantity").alias("y"))


def brand_panel(spark: SparkSession, sf_dir: str, fill: bool = False) -> DataFrame:
    """id, d, y on every day; y null (or 0) on days without sales."""
    return panel.densify(brand_daily(spark, sf_dir), ["id"], "d", ["y"], 0.0 if fill else None)


BRAND = """daily AS (
  SELECT p_brand AS id, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), bounds AS (SELECT min(d) AS lo, max(d) AS hi FROM daily), ids AS (SELECT DISTINCT id FROM daily
), spine AS (SELECT id, CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM ids, bounds
), panel AS (SELECT id, d, y FROM spine LEFT JOIN daily USING (id, d)), panel0 AS (SELECT id, d, coalesce(y, 0.0) AS y FROM panel)"""


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (event type), d, n, v: events and their values by day."""
    return t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("id"), F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))


EVENTS = "ev AS (SELECT event_type AS id, CAST(ts AS DATE) AS d, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL)"


def levels_sql(aggs: str) -> str:
    """The sums of a table ``s`` on all levels of the hierarchy."""
    parts = []
    for level in H.LEVELS:
        group = "'Total_X'" if not level else f"{level[0]} || '_X'" if len(level) == 1 else " || '_' || ".join(f"CAST({c} AS VARCHAR)" for c in level)
        parts.append(f"SELECT '{H.level_name(level)}' AS level, {group} AS group_id, {aggs} FROM s GROUP BY ALL")
    return " UNION ALL ".join(parts)
