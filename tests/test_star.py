"""The graph of the test tables takes calls and imports from every order, whatever its key."""

import random
from pathlib import Path

import pytest

from arborlens.graph import CodeGraph
from arborlens.operators.walks import cyclic_files
from arborlens.plans.star import load, snapshots

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "R")]),
    "nation": ("n_nationkey int, n_regionkey int, n_name string", [(0, 0, "N")]),
    "supplier": ("s_suppkey long, s_nationkey int, s_name string", [(k, 0, f"s{k}") for k in range(4)]),
    "lineitem": (
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string, l_returnflag string",
        [(o, n, 10 * o + n, (o + n) % 4, 1.0, 1.0, "d", "R") for o in (1, 2, 3, 4, 50) for n in (1, 2)] + [(7, n, 70 + n, n, 1.0, 1.0, "d", "N") for n in (1, 2)],
    ),
}


def test_every_order(spark, tmp_path):
    for t, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    g = load(spark, str(tmp_path))
    assert sorted((r.src, r.dst) for r in g.labelled("CALLS").collect()) == sorted((f"fn:{10 * o + 1}", f"fn:{10 * o + 2}") for o in (1, 2, 3, 4, 50))
    assert sorted((r.src[-2:], r.dst[-2:]) for r in g.labelled("IMPORTS").collect()) == [("s0", "s1"), ("s1", "s2"), ("s2", "s3"), ("s3", "s0")]
    assert sorted(r.file_path[-2:] for r in cyclic_files(g).collect()) == ["s0", "s1", "s2", "s3"]
    assert cyclic_files(g, 3).collect() == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_snapshots_share_what_no_function_touches(spark):
    a, b = snapshots(load(spark, "/root/testdata/sf0.001"))
    kinds = [("CONTAINS", "File", "Function"), ("CONTAINS", "Class", "Function"), ("CONTAINS", "File", "Variable"), ("CONTAINS", "Class", "Variable"), ("CONTAINS", "File", "Class"), ("IMPLEMENTS", "Class", "Class")]
    assert [a.labelled(*k).sameSemantics(b.labelled(*k)) for k in kinds] == [False, False, True, True, True, True]


def test_cyclic_files_match_brute_force(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)} | {(100 + k, 100 + (k + 1) % 5) for k in range(5)} | {(200 + k, 200 + (k + 1) % 6) for k in range(6)}
    e = spark.createDataFrame([(str(a), "File", str(b), "File", "IMPORTS") for a, b in pairs], "src string, src_type string, dst string, dst_type string, label string")
    want = set()
    for s in {a for a, _ in pairs}:
        front = {s}
        for _ in range(5):
            front = {b for a, b in pairs if a in front}
            if s in front:
                want.add(str(s))
    got = [r.file_path for r in cyclic_files(CodeGraph(None, None, None, None, e)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and "100" in want and "200" not in want
