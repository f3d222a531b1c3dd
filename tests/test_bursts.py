"""Bursts from keyed state: against the batch form, over several runs, and by the clock."""

import random
import time
from datetime import datetime, timedelta, timezone

import numpy as np
from arborlens.streaming.bursts import bursts, keyed_state, merged, quiet_paths

SCHEMA = "path string, event string, ts timestamp"
T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def brute(events, gap):
    out = []
    for path in {p for p, *_ in events}:
        open_ = []
        for t, e in sorted((t, e) for p, e, t in events if p == path):
            if open_ and (t - open_[-1][0]).total_seconds() <= gap:
                open_.append((t, e))
            else:
                if open_:
                    out.append((path, open_[0][0], open_[-1][0], open_[-1][1], len(open_)))
                open_ = [(t, e)]
        out.append((path, open_[0][0], open_[-1][0], open_[-1][1], len(open_)))
    us = lambda t: int((t - T0) / timedelta(microseconds=1)) + int(T0.timestamp()) * 1_000_000
    return sorted((p, us(a), us(b), e, n) for p, a, b, e, n in out)


def run(spark, tmp_path, **options):
    """One run over the files that are there; what has come out so far."""
    events = spark.readStream.schema(SCHEMA).options(**options).parquet(f"{tmp_path}/in")
    with keyed_state(spark):
        q = bursts(events, 1500, "2 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("path", "first_us", "last_us", "last_event", "n").collect())


def test_merging():
    rng = random.Random(3)
    for _ in range(200):
        ts = np.array([rng.randrange(0, 200) for _ in range(rng.randint(1, 30))])
        events = np.array([rng.choice("abc") for _ in ts])
        whole, held = merged([], ts, events, 7), []
        order = list(range(len(ts)))
        rng.shuffle(order)
        for k in range(0, len(order), 4):
            held = merged(held, ts[order[k : k + 4]], events[order[k : k + 4]], 7)
        assert held == whole and sum(b[3] for b in whole) == len(ts)
        assert all(b[0] - a[1] > 7 for a, b in zip(whole, whole[1:]))


def test_each_burst_comes_once_over_runs(spark, tmp_path):
    rng = random.Random(4)
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    every, seen = [], []
    for part in range(3):
        rows = [(rng.choice(["hot", "hot", "b", "c", f"p{k % 7}"]), rng.choice(["write", "create", "remove"]), at(part * 30 + rng.uniform(0, 29))) for k in range(80)]
        rows.append(("edge", "write", at(part * 30 + 20)))
        rows.append(("edge", "create", at(part * 30 + 21.5)))
        rng.shuffle(rows)
        every += rows
        put(rows)
        now = run(spark, tmp_path)
        assert set(seen) <= set(now) and len(set(now)) == len(now)
        seen = now
    assert 0 < len(seen) < len(brute(every, 1.5))  # the last wait for time to pass
    put([(None, None, at(1000))])
    assert run(spark, tmp_path) == brute(every, 1.5)
    assert run(spark, tmp_path) == brute(every, 1.5)


def test_settings_are_restored(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with keyed_state(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before


def test_by_the_clock(spark, tmp_path):
    rows = [("a", "create", at(0)), ("a", "write", at(500)), ("b", "remove", at(1))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    with keyed_state(spark):
        q = quiet_paths(events, 1000).writeStream.format("memory").queryName("quiet_test").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("quiet_test").count() < 2:
            time.sleep(0.3)
        got = sorted((r.path, r.last_event, r.n) for r in spark.table("quiet_test").collect())
        assert got == [("a", "write", 2), ("b", "remove", 1)]
    finally:
        q.stop()
