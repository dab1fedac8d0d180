"""Sessions with timers: arbitrary state of each user, closed by event time.

A processor holds a user's open sessions as state and sets one timer, where the first of them would end. When the watermark passes it,
all sessions that have ended are handed out once and leave the state, and the timer is set for the first that is left, so that a
user costs a few calls a batch, however many sessions it has. State is bounded by the sessions that are open within the delay, not by the users ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelforge.streaming.events import _finish

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Spans (first, last, n) in milliseconds, joined where one begins less than ``gap`` after another's last row."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spans):
        if out and first < out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


EMPTY = pd.DataFrame({"user_id": [], "first": [], "end": [], "n": []})


class Sessions(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs()
        held, new = self._held(), []
        for pdf in rows:
            times = pdf["at"]
            new += [(t, t, 1) for t in times[times + self.gap > late].tolist()]  # rows of ended sessions are late
        if new:
            self._keep(held, merged(held + new, self.gap))
        yield EMPTY

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = self._held()
        ended = [x for x in held if x[1] + self.gap <= at]
        rest = [x for x in held if x[1] + self.gap > at]
        if ended:
            self._keep([], rest)
        yield pd.DataFrame({"user_id": [key[0]] * len(ended), "first": [x[0] for x in ended], "end": [x[1] + self.gap for x in ended], "n": [x[2] for x in ended]}) if ended else EMPTY

    def _held(self) -> list[tuple[int, int, int]]:
        return [tuple(x) for x in self.open.get()] if self.open.exists() else []

    def _keep(self, before: list, now: list) -> None:
        """Stores the sessions, which are in order, and moves the timer to the first one's end."""
        was, ends = (x[0][1] + self.gap if x else None for x in (before, now))
        if was != ends:
            if was is not None:
                self.handle.deleteTimer(was)
            if ends is not None:
                self.handle.registerTimer(ends)
        if now:
            self.open.put(now)
        else:
            self.open.clear()


def closed_sessions(events: DataFrame, gap_ms: int, late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: each session once, when the watermark (``late`` behind the newest row of the batch before) has passed its end.

    A session ends ``gap_ms`` after its last row; rows that come in any order within the delay join or link sessions. Rows whose session would
    have ended by the watermark are dropped. Sessions that are still open when the stream stops stay in the state.
    """
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("at"))
        out = rows.groupBy("user_id").transformWithStateInPandas(Sessions(gap_ms), "user_id long, first long, end long, n long", "Append", "EventTime")
        done = _finish(out, "append", [])
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return done.select("user_id", F.timestamp_millis("first").alias("start"), F.timestamp_millis("end").alias("end"), "n")
