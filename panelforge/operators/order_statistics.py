"""Rolling quantiles over long frames: one pass over each sorted series with a sliding ordered list.

A frame's values are kept in order; a row puts its value in and takes the oldest out, so its cost is a search and a
move of at most a frame of numbers, not a sort of the frame. Series stream through a task batch by batch: what
is held is one frame, however long the series is. (A frame of a few rows is better served by ``windows.rolling``.)
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.scan import _differs


class Frame:
    """The last n values in order of arrival and of size; nulls take a place but no rank."""

    def __init__(self, n: int):
        self.n, self.arrived, self.ranked = n, deque(), []

    def push(self, x: float | None) -> None:
        self.arrived.append(x)
        if x is not None:
            insort(self.ranked, x)
        if len(self.arrived) > self.n and (old := self.arrived.popleft()) is not None:
            del self.ranked[bisect_left(self.ranked, old)]

    def quantile(self, q: float) -> float:
        """Linear interpolation between the two ranks beside q."""
        at = q * (len(self.ranked) - 1)
        k = int(at)
        low = self.ranked[k]
        return low if at == k else low + (self.ranked[k + 1] - low) * (at - k)


def rolling_quantiles(df: DataFrame, keys: list[str], order: list[str], c: str, frames: dict[int, dict[str, float]], min_periods: int | None = None) -> DataFrame:
    """Adds for each frame length the named quantiles of the last so many rows, the current one included.

    Null until a frame holds ``min_periods`` values (default: its length) that aren't null. NaN counts as null. Rows are
    dealt by key, sorted and streamed; ``order`` should be unique in a series. Null keys are a series; an empty table gives an empty result.
    """
    names = [name for qs in frames.values() for name in qs]
    kept = [k for k in df.columns if k not in names]
    source = df.select(*kept, F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("__x")).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.select(*kept).schema.fields, *[T.StructField(name, T.DoubleType()) for name in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            begins = [False] * b.num_rows
            for k in keys:
                for at in _differs(b.column(k)).nonzero()[0]:
                    begins[at + 1] = True
            first = tuple(b.column(k)[0].as_py() for k in keys)
            begins[0] = last is None or first != last
            last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
            out = {name: [] for name in names}
            for x, new in zip(b.column("__x").to_pylist(), begins):
                if new:
                    held = [(Frame(n), qs, n if min_periods is None else max(min_periods, 1)) for n, qs in frames.items()]
                for frame, qs, least in held:
                    frame.push(x)
                    enough = len(frame.ranked) >= least
                    for name, q in qs.items():
                        out[name].append(frame.quantile(q) if enough else None)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *(pa.array(out[name], pa.float64()) for name in names)], schema.names)

    return source.mapInArrow(run, schema)
