"""Session factory and the folder for files that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "panelforge", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """ANSI mode, UTC and adaptive execution; shuffle partitions only where the caller knows better."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all nodes share (spark.checkpoint.dir), a local one only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='panelforge-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/panelforge/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame, name: str) -> DataFrame:
    """Writes to the shared folder as Parquet and reads back: later reads prune columns and survive lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
