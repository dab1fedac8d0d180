"""Helpers that the operators of this subpackage share.

Rules that hold for all of them: an operator names the columns it reads; every
other input column is passed on, and an input column that has the name of a
column the operator adds is replaced by it. Null texts count as empty.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; it bounds what a Python worker holds of long texts.
ARROW_ROWS = 512
#: Most bytes that an operator broadcasts; beyond it the shuffled way is taken.
BROADCAST_BYTES = 32 << 20


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the rows of the session's Arrow batches, so that workers' memory is bounded."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='panelforge-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_OPEN: list[list[DataFrame]] = []


@contextmanager
def passing() -> Iterator[None]:
    """Deletes at its end what written() wrote inside it, except what is kept."""
    _OPEN.append([])
    try:
        yield
    finally:
        for df in _OPEN.pop():
            forget(df)


def written(df: DataFrame, name: str, keep: bool = False, max_rows: int = 0, codec: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors.

    ``max_rows`` bounds the rows of a file (0: no bound), for tables of very wide rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelforge/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", max_rows).parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _OPEN and not keep:
        _OPEN[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint behind a size check; beyond the bound Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(taken: list[str], *names: str) -> list[str]:
    """These names, with underscores before them until no column has them (in any case of letters)."""
    lower = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        lower.add(name.lower())
        out.append(name)
    return out


def crc32_sql(octets: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a list of bytes."""
    bits = "[0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]"
    one = f"list_reduce(list_prepend(xor(c, b), {bits}), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, ({octets})::BIGINT[]), lambda c, b: {one}), 4294967295::BIGINT)"
