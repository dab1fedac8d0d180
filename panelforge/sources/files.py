"""Sources and sinks: CSV, JSON lines, Parquet, item datasets, checkpoints and synthetic series."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelforge.session import checkpoint, shared_path  # noqa: F401  checkpoints are a source and a sink too

ITEM = "id string, start date, target array<double>"


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A CSV scan with a header and an explicit schema; never infers."""
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", **options).csv(path)


def write_csv(df: DataFrame, path: str, digits: int | None = None, compression: str = "none") -> None:
    """A CSV sink; with ``digits`` doubles are rounded."""
    if digits is not None:
        df = df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
    df.write.options(header=True, compression=compression).csv(path)


def parse_date(c: str, formats: list[str]) -> Column:
    """The date under the first format that fits; null where none does."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.col(c), F.lit(f))) for f in formats])


def read_tagged(spark: SparkSession, root: str, tag: str) -> DataFrame:
    """All folders ``<tag>=<value>`` under a root in one scan, the value as text: a filter on it skips folders."""
    fields = [StructField(f.name, StringType()) if f.name == tag else f for f in spark.read.parquet(root).schema]
    return spark.read.schema(StructType(fields)).parquet(root)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def as_items(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """One row a series: start and the values in the order of days."""
    series = F.sort_array(F.collect_list(F.struct(day, value)))
    return df.groupBy(*keys).agg(F.min(day).alias("start"), F.transform(series, lambda x: x[value]).alias("target"))


def save_dataset(df: DataFrame, keys: list[str], day: str, value: str, root: str) -> None:
    """Items as JSON lines in ``train`` and one line of metadata in ``metadata``."""
    as_items(df, keys, day, value).write.json(f"{root}/train")
    df.agg(F.count("*").alias("rows"), F.min(day).alias("first"), F.max(day).alias("last")).write.json(f"{root}/metadata")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM).option("recursiveFileLookup", True).json(path)


def list_dataset(spark: SparkSession, items: list[tuple[str, str, list[float]]]) -> DataFrame:
    return spark.createDataFrame(items, "item string, start string, target array<double>").withColumn("start", F.to_date("start"))


#: Named datasets: name -> function of (spark, folder); plans add theirs.
DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A registered dataset by name."""
    if name not in DATASETS:
        raise KeyError(f"no dataset {name}; there are {sorted(DATASETS)}")
    return DATASETS[name](spark, sf_dir)


def synthetic(spark: SparkSession, n_series: int, n_steps: int, level: float, trend: float, season: int, amplitude: float, noise: float, seed: int = 7) -> DataFrame:
    """id, step, y of series with level, trend, season and normal noise (seeded)."""
    grid = spark.range(n_series * n_steps).select(F.floor(F.col("id") / n_steps).alias("id"), (F.col("id") % n_steps).alias("step"))
    y = level + trend * F.col("step") + amplitude * F.sin(2 * math.pi * F.col("step") / season)
    return grid.select("id", "step", F.round(y + noise * F.randn(seed) if noise else y, 6).alias("y"))
