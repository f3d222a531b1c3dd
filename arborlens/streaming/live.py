"""Live updates: a directory-watching stream source, per-path debounce, and delta batches."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..schema import EXTENSIONS
from ..sources.ignore import load_patterns, matcher
from .bursts import keyed_state, quiet_paths

GAP = "1500 milliseconds"


class DirectoryWatch(DataSource):
    """Stream of (path, event, ts): files that appeared, changed or went since the last look.

    ``spark.dataSource.register(DirectoryWatch)``, then ``readStream.format("dirwatch").option("path", root)``.
    A file is reported when its last change is ``quiet`` milliseconds old (1500 by default): of changes that
    follow each other faster, only the last counts.  What the ignore file of the root names is not looked at.
    """

    @classmethod
    def name(cls) -> str:
        return "dirwatch"

    def schema(self) -> str:
        return "path string, event string, ts timestamp"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _WatchReader(self.options["path"], int(self.options.get("quiet", "1500")))


class _WatchReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, quiet: int = 1500):
        self.root, self.quiet, self.ignored = root, quiet * 1_000_000, matcher(load_patterns(root))

    def _look(self, seen: dict[str, int]) -> dict[str, int]:
        out = {}
        for folder, folders, names in os.walk(self.root):
            here = os.path.relpath(folder, self.root)
            at = (lambda n: n) if here == "." else (lambda n, here=here: f"{here}/{n}")
            folders[:] = sorted(d for d in folders if not self.ignored(at(d)))
            for n in names:
                p = at(n)
                if os.path.splitext(n)[1].lower() in EXTENSIONS and not self.ignored(p):
                    try:
                        changed = os.stat(os.path.join(folder, n)).st_mtime_ns
                    except OSError:  # went meanwhile
                        continue
                    if changed != seen.get(p) and 0 <= time.time_ns() - changed < self.quiet:
                        if p in seen:  # still being written: as it was, for now
                            out[p] = seen[p]
                        continue
                    out[p] = changed
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seen": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        import datetime

        seen = start["seen"]
        now = self._look(seen)
        at = datetime.datetime.now(datetime.timezone.utc)
        rows = [(p, "create" if p not in seen else "write", at) for p, t in now.items() if seen.get(p) != t]
        rows += [(p, "remove", at) for p in seen if p not in now]
        return iter(rows), {"seen": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        import datetime

        seen, now = start["seen"], end["seen"]
        at = datetime.datetime.now(datetime.timezone.utc)
        rows = [(p, "create" if p not in seen else "write", at) for p, t in now.items() if seen.get(p) != t]
        return iter(rows + [(p, "remove", at) for p in seen if p not in now])


def debounce(events: DataFrame, gap: str = GAP, delay: str | None = "10 seconds") -> DataFrame:
    """(path, last_ts, last_event, n): one row for each burst of a path's events, those at most ``gap`` apart.

    On a stream the watermark ``delay`` bounds the state; a burst is emitted once the watermark has passed it.
    """
    if events.isStreaming and delay:
        events = events.withWatermark("ts", delay)
    bursts = events.groupBy("path", F.session_window("ts", gap)).agg(F.max("ts").alias("last_ts"), F.max_by("event", "ts").alias("last_event"), F.count("*").alias("n"))
    return bursts.select("path", "last_ts", "last_event", "n")


def debounce_batch(events: DataFrame, gap_seconds: float = 1.5) -> DataFrame:
    """The same over a finished table by window functions: a new burst starts more than the gap after the last event."""
    w = Window.partitionBy("path").orderBy("ts")
    apart = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    marked = events.withColumn("_new", F.when(apart.isNull() | (apart > int(gap_seconds * 1_000_000)), 1).otherwise(0)).withColumn("_k", F.sum("_new").over(w))
    return marked.groupBy("path", "_k").agg(F.max("ts").alias("last_ts"), F.max_by("event", "ts").alias("last_event"), F.count("*").alias("n")).drop("_k")


def follow(spark: SparkSession, root: str, apply: Callable[[list[str], list[str]], None], checkpoint: str, quiet_ms: int = 1500):
    """Start a query that calls ``apply(changed, removed)`` with the paths under ``root`` that have been quiet for ``quiet_ms``.

    The source reports each change as it sees it; what follows faster is held together by a timer for each path.
    """
    spark.dataSource.register(DirectoryWatch)
    events = spark.readStream.format("dirwatch").option("path", root).option("quiet", "0").load()

    def batch(df: DataFrame, _: int) -> None:
        last = df.groupBy("path").agg(F.max_by("last_event", "last_us").alias("event")).collect()
        if last:
            apply([r.path for r in last if r.event != "remove"], [r.path for r in last if r.event == "remove"])

    with keyed_state(spark):
        return quiet_paths(events, quiet_ms).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{quiet_ms} milliseconds").start()
