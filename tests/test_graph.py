"""Micro-fixtures of the graph operators: rows worked out by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from arborlens.graph import CodeGraph
from arborlens.operators import diff, health, lookup, walks
from arborlens.schema import TABLES
from arborlens.store import GraphStore


def graph(spark, functions=(), classes=(), variables=(), files=(), edges=()):
    fn = [(i, n, p, 1, 2, d, e, h) for i, n, p, d, h, e in functions]
    rows = {"files": [(p, h, 0) for p, h in files], "functions": fn, "classes": list(classes), "variables": list(variables), "edges": list(edges)}
    return CodeGraph(**{n: spark.createDataFrame(rows[n], s) for n, s in TABLES.items()})


def calls(*pairs):
    return [(a, "Function", b, "Function", "CALLS") for a, b in pairs]


def fns(names, exported=False):
    return [(n, n, f"{n}.go", "", f"h{n}", exported) for n in names]


def chain(g, target, depth):
    return {r.caller_name: r.walks for r in walks.call_chain(g, target, depth).collect()}


def test_call_chains(spark):
    g = graph(spark, fns("abc"), edges=calls("ab", "bc"))
    assert chain(g, "c", 1) == {"b": 1} and chain(g, "c", 2) == {"a": 1, "b": 1}
    assert chain(graph(spark, fns("ac"), edges=calls("ac", "ac")), "c", 1) == {"a": 2}
    loop = graph(spark, fns("ab"), edges=calls("ab", "ba"))
    assert chain(loop, "a", 3) == {"b": 2, "a": 1}
    assert chain(loop, "a", -1) == chain(loop, "a", 1) and chain(loop, "a", 9) == chain(loop, "a", 5)
    assert walks.call_chain(loop, "a", 3, "bag").count() == 3 and walks.call_chain(loop, "a", 3, "distinct").count() == 2


def test_call_chain_is_the_number_of_walks(spark):
    edges = [(a, b) for a, b in itertools.product("abcd", repeat=2) if (ord(a) * 7 + ord(b) * 3) % 5 < 3] + [("a", "b")]
    g = graph(spark, fns("abcd"), edges=calls(*edges))
    count = {}

    def go(node, depth):
        for x, y in edges:
            if y == node:
                count[x] = count.get(x, 0) + 1
                if depth > 1:
                    go(x, depth - 1)

    go("d", 4)
    assert chain(g, "d", 4) == count


def test_cycles_through_hubs(spark, monkeypatch):
    monkeypatch.setattr(walks, "HUBS", 64)
    monkeypatch.setattr(walks, "BATCHES", 2)
    passes, through = [], walks._through_hubs
    monkeypatch.setattr(walks, "_through_hubs", lambda *a: passes.append(through(*a)) or passes[-1])
    rng = random.Random(5)
    e = {(rng.randrange(400), rng.randrange(400)) for _ in range(1100)} | {(a, a + rng.randint(1, 9)) for a in range(500, 900) for _ in range(3)} | {(a, 1000 + (a + 1) % 6) for a in range(1000, 1006)}
    out = {}
    for a, b in e:
        out.setdefault(a, set()).add(b)
    g = graph(spark, edges=[(f"f{a}", "File", f"f{b}", "File", "IMPORTS") for a, b in e])
    for depth in (3, 4, 5):
        want, reach = set(), {a: {a} for a in out}
        for _ in range(depth):
            reach = {a: set().union(*(out.get(b, ()) for b in bs)) for a, bs in reach.items()}
            want |= {f"f{a}" for a, bs in reach.items() if a in bs}
        passes.clear()
        assert sorted(r.file_path for r in walks.cyclic_files(g, depth).collect()) == sorted(want)
        assert passes and passes[0].count() > 0


def test_cycles(spark):
    e = [(a, "File", b, "File", "IMPORTS") for a, b in ("fg", "gh", "hf", "xf")]
    assert {r.file_path for r in walks.cyclic_files(graph(spark, edges=e)).collect()} == set("fgh")
    assert [r.file_path for r in walks.cycles(graph(spark, edges=e), 2).collect()] == ["f", "g"]


def test_hot_spots(spark):
    cl = [("k", "K", "a", "", "class", ""), ("l", "L", "a", "", "class", ""), ("m1", "M", "b", "", "class", ""), ("m2", "M", "b", "", "class", "")]
    e = [("k", "Class", x, t, "CONTAINS") for x, t in (("f", "Function"), ("g", "Function"), ("v", "Variable"))] + [("m1", "Class", "h", "Function", "CONTAINS"), ("m2", "Class", "i", "Function", "CONTAINS")]
    assert [tuple(r) for r in health.god_objects(graph(spark, classes=cl, edges=e)).collect()] == [("K", "a", 3), ("M", "b", 2)]
    g = graph(spark, fns("abc"), edges=calls("ab", "ab", "cb", "ac"))
    assert [tuple(r) for r in health.black_holes(g).collect()] == [("b", "b.go", 3), ("c", "c.go", 1)]


def test_clones_and_dead_code(spark):
    rows = [("1", "x", "a", "", "h", False), ("2", "y", "b", "", "h", False), ("3", "z", "b", "", "u", False), ("4", "w", "b", "", "v", True), ("5", "n", "b", "", None, True), ("6", "e", "b", "", "", True), ("7", "e2", "b", "", "", True)]
    g = graph(spark, rows)
    got = health.clone_groups(g).collect()
    assert [(r.ast_hash, [f.name for f in r.functions]) for r in got] == [("h", ["x", "y"])]
    assert {r.function_name for r in health.dead_code(g).collect()} == {"x", "y", "z"}
    m = health.ai_metrics(g).first()
    assert (m.functions, m.cloned, m.dead, m.BVI, m.AOI) == (7, 2, 3, 0, 0.0)


def test_metrics_edges(spark):
    m = health.ai_metrics(CodeGraph.empty(spark)).first()
    assert (m.SCR, m.DCR, m.AOI, m.functions) == (0.0, 0.0, 0.0, 0)
    df = spark.createDataFrame([(0.10, 0.06, 0, 0.5)], "SCR double, DCR double, BVI int, AOI double")
    assert {r.metric: r.status for r in health.metric_status(df).collect()} == {"SCR": "Pass", "DCR": "Danger", "BVI": "Pass", "AOI": "Pass"}


def test_boundaries(spark):
    f = [("1", "x", "p/api/a.go", "", "", True), ("2", "y", "p/db/b.go", "", "", True)]
    g = graph(spark, f, edges=calls("12", "12"))
    got = health.boundary_violations(g, [("api", "db"), ("db", "api")]).collect()
    assert [(r.from_symbol, r.to_symbol, r.rule_violated) for r in got] == [("x", "y", "api -> db")] * 2
    assert health.boundary_violations(g, [("", "")]).count() == 2 and health.boundary_violations(g, []).count() == 0


def test_search_and_structure(spark):
    g = graph(spark, [("1", "runIt", "a", "does things", "", True)], [("c", "Run", "a", "", "struct", "")], [("v", "rung", "a", "int")], [("a", "")],
              [("a", "File", "1", "Function", "CONTAINS"), ("a", "File", "c", "Class", "CONTAINS"), ("c", "Class", "v", "Variable", "CONTAINS")])
    names = lambda t: {(r.type, r.name) for r in lookup.search(g, t).collect()}
    assert names("run") == {("Function", "runIt"), ("Variable", "rung")} and names("things") == {("Function", "runIt")}
    assert names("") == {("Function", "runIt"), ("Class", "Run"), ("Variable", "rung")}
    assert {(r.type, r.name, r.class_name) for r in lookup.file_structure(g, "a").collect()} == {("Function", "runIt", None), ("Class", "Run", None), ("Field", "rung", "Run")}
    assert tuple(lookup.function_range(g, "1").first()) == ("a", 1, 2) and lookup.function_range(g, "?").first() is None
    df = spark.createDataFrame([("l1\nl2\nl3",)], "t string")
    cut = lambda a, b: df.select(lookup.line_slice(F.col("t"), F.lit(a), F.lit(b))).first()[0]
    assert (cut(2, 3), cut(1, 1), cut(3, 9), cut(9, 9), cut(3, 2)) == ("l2\nl3", "l1", "l3", "", "")


def test_maintenance_equals_a_full_build(spark, tmp_path):
    g = graph(spark, [("1", "x", "a", "", "", True), ("2", "y", "b", "", "", True)], files=[("a", ""), ("b", "")], edges=[*calls("12", "21", "12"), ("a", "File", "b", "File", "IMPORTS"), ("a", "File", "1", "Function", "CONTAINS")])
    less = g.delete_files(spark.createDataFrame([("a",)], "path string"))
    assert less.edges.count() == 0 and less.functions.count() == 1 and not less.has_file("a") and less.has_file("b")
    again = less.insert(files=g.files, functions=g.functions, edges=g.edges)
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    assert less.insert(edges=g.edges).edges.count() == 0
    assert g.invalid_edges().count() == 0
    bad = spark.createDataFrame([("a", "File", "b", "File", "CALLS")], TABLES["edges"])
    assert CodeGraph(g.files, g.functions, g.classes, g.variables, bad).invalid_edges().count() == 1
    store = GraphStore(spark, str(tmp_path / "store"))
    assert store.load().is_empty()
    first = store.save(g)
    assert store.version() == first and store.load().edges.count() == 5
    store.save(less)
    assert store.version() != first and store.load().edges.count() == 0
    with pytest.raises(PermissionError):
        GraphStore(spark, str(tmp_path / "store"), read_only=True).save(g)


def test_a_version_is_written_without_a_sort_of_its_edges(spark, tmp_path):
    kinds = [(f"f{k}", "File", f"g{k}", "File" if k % 2 else "Function", "IMPORTS" if k % 2 else "CONTAINS") for k in range(200)]
    g, store = graph(spark, edges=[*kinds, *calls("ab", "ba")]), GraphStore(spark, str(tmp_path / "store"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    v = store.save(g)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    plans, ran = spark._jsparkSession.sharedState().statusStore(), []
    for k in range(plans.executionsCount()):
        ran.append(plans.executionsList(k, 1).apply(0).physicalPlanDescription())
    mine = [p for p in ran if f"{v}/edges" in p and "InsertInto" in p]
    assert mine and not any("Sort" in p for p in mine)
    assert sorted(map(tuple, store.load().edges.collect())) == sorted(map(tuple, g.edges.collect()))


def test_diff(spark):
    g = graph(spark, [("1", "x", "a", "", "h", True)], variables=[("v", "v", "a", "int")], files=[("a", "1")], edges=[("a", "File", "1", "Function", "CONTAINS")])
    assert diff.diff_nodes(g, g).count() == diff.diff_edges(g, g).count() == 0
    other = graph(spark, [("1", "x", "a", "", "k", True), ("2", "z", "a", "", "k", True)], variables=[("v", "v", "a", "long")], files=[("a", "2")])
    assert {(r.change, r.id) for r in diff.diff_nodes(g, other).collect()} == {("modified", "a"), ("modified", "a::x"), ("deleted", "a::z")}
    assert [tuple(r) for r in diff.diff_edges(g, other).collect()] == [("added", "a", "a::x", "CONTAINS")]


def test_edges_that_both_graphs_take_from_the_same_tables(spark):
    edges = [("a", "File", "1", "Function", "CONTAINS"), ("a", "File", "v", "Variable", "CONTAINS"), ("a", "File", "w", "Variable", "CONTAINS"), ("k", "Class", "k", "Class", "IMPLEMENTS")]
    g = graph(spark, [("1", "x", "a", "", "h", True)], [("k", "K", "a", "", "class", "")], [("v", "x", "a", "int"), ("w", "w", "a", "int")], [("a", "1")], edges)
    other = CodeGraph(**g.tables() | {"functions": g.functions.withColumn("name", F.lit("y"))})
    got = diff.diff_edges(g, other)
    # The function's edge has the same ends as the variable's, which is on both sides.
    assert [tuple(r) for r in got.collect()] == [("deleted", "a", "a::y", "CONTAINS")]
    assert [tuple(r) for r in diff.diff_edges(other, g).collect()] == [("added", "a", "a::y", "CONTAINS")]
    assert "IMPLEMENTS" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert diff.diff_edges(g, g).collect() == [] and "Exchange" not in diff.diff_edges(g, g)._jdf.queryExecution().executedPlan().toString()


def test_ten_thousand_boundary_rules(spark):
    rng = random.Random(6)
    paths = [f"d{k % 37}/e{k % 11}/f{k}.go" for k in range(300)]
    fn = [(f"f{k}", f"n{k}", p, "", "", True) for k, p in enumerate(paths)]
    calls = [(f"f{rng.randrange(300)}", "Function", f"f{rng.randrange(300)}", "Function", "CALLS") for _ in range(500)]
    imports = [(rng.choice(paths), "File", rng.choice(paths), "File", "IMPORTS") for _ in range(100)]
    rules = [(f"d{k % 41}/", f"f{k}.") for k in range(10_000)] + [("", "e3/f3."), ("e3/f3.", "")] * 2
    g = graph(spark, functions=fn, edges=calls + imports)
    of = {f[0]: f[2] for f in fn}
    ends = [("CALL", of[s], of[d]) for s, _, d, *_ in calls] + [("IMPORT", s, d) for s, _, d, *_ in imports]
    want = sorted((t, s, d, f"{a} -> {b}") for t, s, d in ends for a, b in rules if a in s and b in d)
    got = sorted((r.type, r.from_path, r.to_path, r.rule_violated) for r in health.boundary_violations(g, rules).collect())
    assert got == want and len(want) > 10


def test_search_by_index(spark, tmp_path):
    from arborlens.operators.search_index import build_index, candidates, search_indexed

    rng = random.Random(12)
    say = lambda k: "".join(rng.choices("abcé𝄞A ", k=k))
    fn = [(f"f{k}", say(rng.randint(0, 12)), "a.go", rng.choice([say(20), "", None]), "", True) for k in range(300)]
    cl = [(f"c{k}", say(rng.randint(0, 9)), "b.go", rng.choice([say(9), None]), "class", "") for k in range(100)]
    va = [(f"v{k}", rng.choice([say(5), None]), "c.go", "int") for k in range(100)]
    g, path = graph(spark, fn, cl, va), f"{tmp_path}/index"
    build_index(g, path, 7)
    shown = lambda df: sorted(map(str, df.collect()))
    for text in ["abc", "a", "", "é𝄞", "ab ", "aaaa", "A bA", "zzz", fn[3][1], cl[5][1], "𝄞𝄞𝄞"]:
        assert shown(search_indexed(spark, path, text, 7)) == shown(lookup.search(g, text)), text
    assert candidates(spark, path, "zzz", 7).collect() == []
    plan = candidates(spark, path, "abcab", 7)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in plan
    empty = f"{tmp_path}/empty"
    build_index(graph(spark), empty, 7)
    assert search_indexed(spark, empty, "abc", 7).collect() == [] == search_indexed(spark, empty, "", 7).collect()
