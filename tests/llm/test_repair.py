import hashlib
import random
import re
import zlib
from heapq import heappop, heappush
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from arborlens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def tie(conv, role, text):
    return hashlib.sha256(f"{'-' if conv is None else f'c{conv}'}\n{len(role)}:{role}{text}".encode()).digest()


def damaged(rows):
    out = []
    for c, t, r, x, *_ in rows:
        r, x = " " if r is None else r, " " if x is None else x
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f:
            out += [(c, t, "user" if f == 4 else r, "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x)] * (2 if f == 3 else 1)
    return out


def faults_of(turns):
    seen, out = set(), []
    for _, r, x in turns:
        ends = x.strip(BLANK)
        out.append("blank" if not ends else "duplicate" if (r, x) in seen else "truncated" if ends[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(turns, faults):
    """Dijkstra over (rows done, roles so far as far as they matter), with whole audit texts."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, k, tail, said = heappop(queue)
        if (k, tail) in done:
            continue
        done.add((k, tail))
        if k == len(turns) and tail in ("", "a"):
            return cost, audit, said
        def put(more, letter, step, role, text, cost=cost, audit=audit, k=k, tail=tail, said=said):
            if role is not None:
                new = role[:1]
                if not new or new not in {"": "su", "s": "u", "u": "a", "a": "u"}[tail]:
                    return
                heappush(queue, (cost + more, audit + letter, k + step, new, (*said, f"{role}:{text}")))
            else:
                heappush(queue, (cost + more, audit + letter, k + step, tail, said))
        for role in ("user", "assistant"):
            put(5, "I", 0, role, "")
        if k < len(turns):
            _, r, x = turns[k]
            put(2, "D", 1, None, None)
            if faults[k] not in ("blank", "duplicate"):
                more = 5 * (faults[k] == "truncated")
                put(more, "K", 1, r, x)
                for role in ("user", "assistant"):
                    put(1 + more, "R", 1, role, x)
    raise AssertionError


def brute(rows, broken=None):
    convs = {c: [] for c, *_ in rows}
    for c, t, r, x in damaged(rows) if broken is None else broken:
        convs[c].append((t, r, x))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, tie(c, t[1], t[2])))
        faults = faults_of(turns)
        cost, audit, said = cheapest(turns, faults)
        assert LEGAL.match("".join(s[:1] for s in said))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def got(df):
    cols = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in cols) for r in rows}
    assert len(out) == len(rows)
    return out


def rows_of(rng, convs, most=9):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            text = rng.choice(["Yes.", "No!", "cut", "cut off ", "", " \n\t", "Why?\n", "é.", None, f"t{t}.", f"t{t}", "x."])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sage", "User"])
            rows.append((rng.choice([c, c, c, c, None]) if most < 12 else c, rng.choice([t, t, t, t + 40, None]), role, text))
    return rows + rows[:5]


def test_matches_dijkstra(spark):
    rows = rows_of(random.Random(2), 250)
    assert got(repair.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_pieces_meet(spark):
    """Long conversations, a hot row among them, in pieces of at most 5 rows."""
    rng = random.Random(8)
    rows = [(c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "c!", f"{t}.", f"{t}?", ""])) for c in (1, 2, 3, 9) for t in range(120 if c == 1 else 30)]
    rows += [(1, 77, "user", "said again.")] * 300
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, rows)
    done = repair.repair(df, piece_rows=5)
    pieces = {r.conv_id: r.n for r in done.turns.groupBy("conv_id").agg(F.count_distinct("piece").alias("n")).collect()}
    assert pieces[1] > 15
    report = done.report.join(repair.digests(done.turns), "conv_id")
    assert got(report) == want


def test_turns_are_the_repaired_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "q?"), (1, 2, "user", "q?"), (1, 3, "assistant", "a."), (1, 4, "user", "last?"), (2, 0, "assistant", "hi."), (2, 1, "assistant", "ho.")]
    done = repair.repair(spark.createDataFrame(rows, SCHEMA))
    turns = [(r.conv_id, r.edit, r.role, r.text) for r in done.turns.orderBy("conv_id", "piece", "k").collect()]
    assert turns == [(1, "K", "system", "S."), (1, "K", "user", "q?"), (1, "K", "assistant", "a."), (2, "R", "user", "hi."), (2, "K", "assistant", "ho.")]
    assert {(r.conv_id, r.cost, r.audit, r.duplicate) for r in done.report.collect()} == {(1, 4, "KKDKD", 1), (2, 1, "RK", 0)}


def test_codes_are_ordered_and_prefix_free():
    assert sorted(repair.CODES) == repair.CODES
    assert not [(a, b) for a in repair.CODES for b in repair.CODES if a != b and b.startswith(a)]


def test_long_text_dropped_conversations_clashes_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), (-5, 1, "user", "w " * 1_000_000 + "end."), (-5, 2, "assistant", "no end " * 300_000)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA + ", piece string, said long")
    out = got(repair.damaged_and_repaired(df))
    assert out == brute(rows)
    assert out[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    named = df.toDF("c d", "t`t", "R", "x.y", "piece", "said")
    assert repair.repair(named, "c d", "t`t", "R", "x.y").report.count() == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.damaged_and_repaired(empty).collect() == [] and repair.repair(empty).turns.collect() == []


def test_sql_matches_dijkstra(tmp_path, spark):
    rows = rows_of(random.Random(4), 60, 6)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/c")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    r = duck.execute(repair.SQL_REPAIRED)
    names = [d[0] for d in r.description]
    assert names[1:] == ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = brute(rows)
    for row in r.fetchall():
        if "" not in {x[2] for x in rows if x[0] == row[0]}:
            assert row[1:] == want[row[0]]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.damaged_and_repaired(df)) == brute(rows)
