"""Streams of session events: windowed counts and active time with bounded state."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tracewell.operators.windows import MAX_GAP_MS


def windowed_counts(events: DataFrame, ts: str, keys: list[str], every: str = "1 day", late: str = "1 hour", start: str | None = None) -> DataFrame:
    """(start, end, keys, n): tumbling windows; events later than ``late`` are dropped (R6). Weeks from Monday: 7 days, start 4 days."""
    timed = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    grid = F.window("__t", every, every, start) if start else F.window("__t", every)
    return timed.groupBy(grid.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


class _ActiveTime(StatefulProcessor):
    """Times within the watermark's reach stay in a sorted list; gaps count for good only behind it."""

    def __init__(self, key: str, idle_ms: int | None, max_gap_ms: int):
        self.key, self.idle_ms, self.max_gap_ms = key, idle_ms, max_gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "last bigint, total bigint")
        self.open = handle.getListState("open", "ms bigint")

    def _after(self, last: int | None, total: int, times: list[int]) -> tuple[int | None, int]:
        for t in times:
            total += min(t - last, self.max_gap_ms) if last is not None else 0
            last = t
        return last, total

    def _row(self, key: tuple, last: int, total: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "active_ms": [total], "last_ms": [last], "closed": [closed]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        edge = timerValues.getCurrentWatermarkInMs()
        state = self.settled.get() if self.settled.exists() else (None, 0)
        open_ = [r[0] for r in self.open.get()] if self.open.exists() else []
        times = sorted([*open_, *(int(t) for part in rows for t in part["ms"])])
        cut = bisect.bisect_left(times, edge)  # what is earlier can't get company any more
        last, total = self._after(*state, times[:cut])
        if last is not None:
            self.settled.update((last, total))
        if times[cut:]:
            self.open.put([(t,) for t in times[cut:]])
        else:
            self.open.clear()
        last, total = self._after(last, total, times[cut:])
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(last, edge) + self.idle_ms)
        yield self._row(key, last, total, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.settled.get() if self.settled.exists() else (None, 0)
        last, total = self._after(*state, [r[0] for r in self.open.get()] if self.open.exists() else [])
        self.settled.clear()
        self.open.clear()
        yield self._row(key, last, total, True)


def active_time(events: DataFrame, key: str, ts: str, late: str = "1 hour", idle: str | None = "1 day", max_gap_ms: int = MAX_GAP_MS) -> DataFrame:
    """(key, active_ms, last_ms, closed): after each batch, the active time so far of the keys that it has.

    Events may come in any order within ``late`` of the newest: their times wait in state, sorted, until the watermark has
    passed them, so every row is what the batch form gives for the events so far. Later ones are dropped. A key without
    events for ``idle`` after the watermark is closed by a last row, and begins at 0 when it comes back; with None keys
    are kept for ever. Needs the RocksDB state store, which is set for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(events.dtypes)[key]
    idle_ms = None if idle is None else pd.Timedelta(idle).value // 1_000_000
    timed = events.select(key, F.col(ts).cast("timestamp").alias("__t")).where("__t is not null").withWatermark("__t", late).withColumn("ms", F.unix_millis("__t"))
    return timed.groupBy(key).transformWithStateInPandas(_ActiveTime(key, idle_ms, max_gap_ms), f"{key} {kind}, active_ms bigint, last_ms bigint, closed boolean", "Update", "EventTime")
