"""Debouncing as keyed state: bursts of a path's events, each given once when its quiet time has passed.

Spark's session windows tell bursts too, but have no timers: they wait for a watermark and can't follow the
clock.  Here a stateful processor holds the open bursts of each path and sets a timer for the first that will be due.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: What a burst is when it is given, and in state: times in microseconds.
BURST = StructType([StructField("path", StringType()), StructField("first_us", LongType()), StructField("last_us", LongType()), StructField("last_event", StringType()), StructField("n", LongType())])
_HELD = StructType(BURST.fields[1:])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that are started inside may hold keyed state; a running query keeps the setting that it started with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def merged(held: list[tuple], ts: np.ndarray, events: np.ndarray, gap: int) -> list[tuple]:
    """Bursts (first, last, last event, n) in order of time with more events added, in any order.

    Events at most ``gap`` apart are one burst; of events at the same time the largest by name is the last.
    """
    order = np.lexsort((events, ts))
    ts, events = ts[order], events[order]
    starts = np.flatnonzero(np.diff(ts, prepend=ts[0] - gap - 1) > gap)
    ends = np.append(starts[1:], len(ts)) - 1
    new = [(int(ts[a]), int(ts[b]), str(events[b]), int(b - a + 1)) for a, b in zip(starts, ends, strict=True)]
    out: list[tuple] = []
    for b in sorted(held + new):
        if out and b[0] - out[-1][1] <= gap:
            a = out[-1]
            last, event = max((a[1], a[2]), (b[1], b[2]))
            out[-1] = (a[0], last, event, a[3] + b[3])
        else:
            out.append(b)
    return out


class _Bursts(StatefulProcessor):
    """Bursts by the events' own times; they are due when the watermark has passed their quiet time."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _HELD)

    def _keep(self, bursts: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if bursts:
            self.open.put(bursts)
            # an event at the very end of the quiet time still belongs to the burst
            self.handle.registerTimer((bursts[0][1] + self.gap) // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        for part in rows:
            held = merged(held, part["us"].to_numpy("int64"), part["event"].fillna("").to_numpy(str), self.gap)
        self._keep(held)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        due = [b for b in held if (b[1] + self.gap) // 1000 + 1 <= now]
        self._keep(held[len(due) :])
        if due:
            yield pd.DataFrame([(key[0], *b) for b in due], columns=BURST.names)

    def close(self) -> None:
        pass


class _Quiet(StatefulProcessor):
    """One burst for each path by the clock: it is due when no event has come for its quiet time."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(self.open.get())] if self.open.exists() else []
        for part in rows:
            # times do not part a burst here, arrivals do
            held = merged(held, part["us"].to_numpy("int64"), part["event"].fillna("").to_numpy(str), 1 << 62)
        self.open.update(held[0])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            burst = tuple(self.open.get())
            self.open.clear()
            yield pd.DataFrame([(key[0], *burst)], columns=BURST.names)

    def close(self) -> None:
        pass


def bursts(events: DataFrame, gap_ms: int = 1500, delay: str = "10 seconds") -> DataFrame:
    """(path, first_us, last_us, last_event, n) of a stream of (path, event, ts): each burst once, ``gap_ms`` after its last event.

    Time is the events'; events later than ``delay`` are dropped by Spark's watermark.  A row with a null path
    and a later time only moves time on: at the end of a finished stream it brings out the last bursts.  State is
    a row for each burst that is not due, in RocksDB; a path's events are merged batch by batch, so their number
    does not matter.
    """
    us = events.where("ts is not null").withWatermark("ts", delay).selectExpr("path", "event", "ts", "unix_micros(ts) AS us")
    out = us.groupBy("path").transformWithStateInPandas(_Bursts(gap_ms * 1000), BURST, "Append", "EventTime")
    return out.where("path is not null")


def quiet_paths(events: DataFrame, gap_ms: int = 1500) -> DataFrame:
    """The same by the clock: a path is given when none of its events has come for ``gap_ms``, all since then as one burst."""
    us = events.where("path is not null and ts is not null").selectExpr("path", "event", "unix_micros(ts) AS us")
    return us.groupBy("path").transformWithStateInPandas(_Quiet(gap_ms * 1000), BURST, "Append", "ProcessingTime")
