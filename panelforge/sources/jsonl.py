"""JSON lines with their place: file, line number and byte span of every row, bad lines among them.

A Python data source cuts files into byte ranges; a range's reader begins at the first line that starts inside it and reads
its last line to the end, so files of any size are split over tasks and no line is read twice. Readers open
paths through pyarrow's file systems (local, HDFS, S3, GCS) and hand over Arrow batches; JSON is parsed by Spark itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelforge.session import checkpoint

SPLIT_BYTES = 64 << 20
#: Bytes that a reader asks for at once, and lines of a batch.
READ_BYTES, BATCH_LINES = 1 << 20, 4096
COLUMNS = "file string, split long, nth long, start long, end long, content string"


class Range(InputPartition):
    def __init__(self, path: str, split: int, start: int, end: int):
        self.path, self.split, self.start, self.end = path, split, start, end


def lines_of(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes (without the line feed) of each line that begins in [start, end); holds one line and one read at most."""
    at = max(start - 1, 0)
    file.seek(at)
    held, skip = b"", start > 0  # what stands before the first line feed belongs to the range before
    while True:
        read = file.read(READ_BYTES)
        if skip:
            cut = read.find(b"\n")
            if cut < 0:
                at += len(read)
                if not read or at >= end:
                    return
                continue
            at, read, skip = at + cut + 1, read[cut + 1 :], False
            if not read:
                continue
        *whole, rest = (held + read).split(b"\n")
        for line in whole:
            if at >= end:
                return
            yield at, line
            at += len(line) + 1
        held = rest
        if len(read) == 0:
            if held and at < end:
                yield at, held
            return
        if at >= end:
            return


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted((f.path, f.size) for f in files if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Range(p, k, s, min(s + self.bytes, size)) for p, size in names for k, s in enumerate(range(0, size, self.bytes))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)

        def batch(rows: list, first: int) -> pa.RecordBatch:
            n = len(rows)
            starts, texts = zip(*rows)
            ends = [s + len(t) for s, t in rows]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            content = [t.decode("utf-8", "replace") for t in texts]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([partition.path] * n, [partition.split] * n, range(first, first + n), starts, ends, content), kinds)], [c.split()[0] for c in COLUMNS.split(", ")])

        with system.open_input_file(partition.path) as file:
            rows, first, held = [], 0, 0
            for at, line in lines_of(file, partition.start, partition.end):
                rows.append((at, line))
                held += len(line)
                if len(rows) >= BATCH_LINES or held >= READ_BYTES:
                    yield batch(rows, first)
                    rows, first, held = [], first + len(rows), 0
            if rows:
                yield batch(rows, first)


class LinesSource(DataSource):
    """``spark.read.format("placed_lines").load(path)``: one row a line, with the option ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "placed_lines"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, line (from 0), start, end (bytes, exclusive), content of every line of a file or folder."""
    spark.dataSource.register(LinesSource)
    rows = spark.read.format("placed_lines").option("splitBytes", str(split_bytes)).load(path)
    counts = checkpoint(rows.groupBy("file", "split").agg((F.max("nth") + 1).alias("c")), "line-counts")
    before = F.coalesce(F.sum("c").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(counts.select("file", "split", before.alias("before")), ["file", "split"])
    return placed.select("file", (F.col("before") + F.col("nth")).alias("line"), "start", "end", "content")


def read_json_lines(spark: SparkSession, path: str, schema: str, bad: str = "fail", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The columns of ``schema`` with file, line, start, end and error.

    A line that isn't one JSON object of that schema is bad: blank ones, broken ones, values of another type. ``bad="fail"`` stops the
    query with its place; ``"keep"`` gives it a row with null values, the error and its place; ``"drop"`` leaves it out. Lines end with a
    line feed; a file's last line needs none. Bytes that aren't UTF-8 are replaced.
    """
    if bad not in ("fail", "keep", "drop"):
        raise ValueError(f"bad is fail, keep or drop, not {bad}")
    parsed = F.from_json("content", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})
    rows = read_lines(spark, path, split_bytes).withColumn("x", parsed)
    broken = F.col("x").isNull() | F.col("x.__bad").isNotNull() | (F.trim("content") == "")
    place = F.format_string("no JSON object of the schema in line %d of %s (bytes %d to %d)", "line", "file", "start", "end")
    rows = rows.withColumn("error", F.when(broken, place))
    if bad == "fail":
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")))
    names = [f.name for f in rows.schema["x"].dataType.fields if f.name != "__bad"]
    out = rows.select(*[F.when(F.col("error").isNull(), F.col(f"x.{c}")).alias(c) for c in names], "file", "line", "start", "end", "error")
    return out.where("error is null") if bad == "drop" else out
