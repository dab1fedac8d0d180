"""Structured Streaming over the events stream: windows, sessions, state and batch deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from panelforge.operators import hierarchy as H
from panelforge.session import shared_path

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """The events file as a stream; its folder is listed for that one name only."""
    reader = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events*.parquet")
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)


def _finish(out: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Runs a stream over what is there and returns its output table, which executors write as Parquet, a folder a batch.

    update: the last row of each key; complete: the last batch; append: all rows.
    A batch that runs again replaces its own folder.
    """
    spark, path, last = out.sparkSession, shared_path(out.sparkSession, "stream"), [0]

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        last[0] = number

    query = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.schema(out.schema).parquet(f"{path}/out/batch={last[0]}")
    rows = spark.read.schema(StructType([*out.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")
    if mode == "append":
        return rows.drop("batch")
    rest = [c for c in out.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*[c if c in keys else f"x.{c}" for c in out.columns])


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window; rows of windows that had ended by the watermark (``late`` behind the newest row) of the batch before are dropped."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return _finish(agg.select(F.col("w.start").alias("start"), "event_type", "n", "v"), "update", ["start", "event_type"])


def sliding(events: DataFrame, width: str, step: str, late: str = "1 hour") -> DataFrame:
    """As ``tumbling``, in windows that overlap."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return _finish(agg.select(F.col("w.start").alias("start"), "event_type", "n"), "update", ["start", "event_type"])


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user. Session windows have no update mode; the complete result of the last batch includes open ones."""
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return _finish(agg.select(F.col("w.start").alias("start"), "user_id", "n"), "complete", [])


def closed_windows(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Counts of the windows that the watermark has passed, each once (append mode)."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return _finish(agg.select(F.col("w.start").alias("start"), "event_type", "n"), "append", [])


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, v: totals that each micro-batch adds to, held as a user's state."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, v = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, v = n + len(pdf), v + float(pdf["value"].sum())
        state.update((n, v))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "v": [v]})

    out = events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(add, "user_id long, n long, v double", "n long, v double", "update", GroupStateTimeout.NoTimeout)
    return _finish(out, "update", ["user_id"])


def level_deltas(events: DataFrame, levels: list[list[str]]) -> DataFrame:
    """level, group_id, n: each micro-batch adds its own sums to all levels, in one pass over its rows (foreachBatch); deltas are kept as files and summed at the end."""
    spark, path = events.sparkSession, shared_path(events.sparkSession, "deltas")
    dims = list(dict.fromkeys(k for level in levels for k in level))

    def add(batch: DataFrame, number: int) -> None:
        bottom = batch.groupBy(*dims).agg(F.count("*").alias("n"))
        H.aggregate(bottom, levels, [], [F.sum("n").alias("n")]).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    events.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    deltas = spark.read.schema("level string, group_id string, n long").parquet(f"{path}/out")
    return deltas.groupBy("level", "group_id").agg(F.sum("n").alias("n"))
