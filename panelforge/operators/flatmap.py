"""User transforms that map rows to any number of rows: table functions with a schema of their arguments."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, DoubleType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Windows:
    """One row in, at most one out: the last ``length`` values, every ``step`` rows from the first full window on.

    Its columns are the partition's keys, the order column and value_0, value_1, ... up to the length. It holds one window.
    """

    @staticmethod
    def analyze(row: AnalyzeArgument, length: AnalyzeArgument, step: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        for a in (length, step):
            if not a.isConstantExpression or not isinstance(a.value, int) or a.value < 1:
                raise ValueError("length and step are whole numbers above zero")
        rest = [f for f in row.dataType.fields if f.name != value.value]
        return AnalyzeResult(StructType([*rest, *[StructField(f"value_{k}", DoubleType()) for k in range(length.value)]]))

    def __init__(self) -> None:
        self.held, self.n = deque(), 0

    def eval(self, row, length: int, step: int, value: str) -> Iterator[tuple]:
        self.held.append(None if row[value] is None else float(row[value]))
        self.n += 1
        if len(self.held) > length:
            self.held.popleft()
        if self.n >= length and (self.n - length) % step == 0:
            yield (*(row[c] for c in row.__fields__ if c != value), *self.held)


def windows(df: DataFrame, keys: list[str], order: str, value: str, length: int, step: int = 1) -> DataFrame:
    """The windows of each series: keys, order (of the last row), value_0 to value_<length - 1>. Series shorter than a window have none."""
    table = df.select(*keys, order, value).asTable().partitionBy(*keys).orderBy(order)
    return udtf(Windows)(table, F.lit(length), F.lit(step), F.lit(value))


def flat_map(df: DataFrame, transform, schema: StructType | DataType) -> DataFrame:
    """Every row through a function that yields any number of tuples of ``schema``, null-safe and in the row's task."""

    class FlatMap:
        def eval(self, row) -> Iterator[tuple]:
            yield from transform(row)

    return udtf(FlatMap, returnType=schema)(df.asTable())
