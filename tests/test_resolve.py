"""Joins that resolve references, against brute force."""

import os
import random
import re
import time

from pyspark.sql import functions as F

from arborlens.plans import resolve

FUNCTIONS = "id string, file_path string, start_line long, end_line long, ord long"
REFS = "callee_id string, ref_path string, ref_line long"


def brute(refs, functions):
    out = []
    for callee, path, line in refs:
        held = [(o, i) for i, p, a, b, o in functions if p == path is not None and line is not None and a is not None and b is not None and a <= line <= b]
        if held and min(held)[1] != callee:
            out.append((min(held)[1], callee))
    return sorted(out)


def got(spark, refs, functions):
    return sorted((r.src, r.dst) for r in resolve.resolve_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(functions, FUNCTIONS)).collect())


def test_references_match_brute_force(spark):
    rng = random.Random(11)
    functions, refs = [], []
    for k in range(400):
        a = rng.randint(0, 600) * rng.choice([1, 1, 1, 300])
        functions.append((f"f{k}", rng.choice(["a.go", "b.go", None]), a, a + rng.choice([0, 1, 7, 8, 9, 63, 64, 65, 511, 70_000, -1]), rng.randint(0, 300)))
    functions += [("whole", "b.go", 0, 40_000_000, 9999), ("nowhere", "a.go", None, 5, 0), functions[3]]
    for _ in range(3000):
        refs.append((f"f{rng.randrange(400)}", rng.choice(["a.go", "b.go", "c.go", None]), rng.choice([rng.randint(0, 700), rng.randint(0, 250_000), 39_999_999, None])))
    refs += [refs[0]] * 5
    assert got(spark, refs, functions) == brute(refs, functions)
    assert got(spark, [], functions) == [] == got(spark, refs[:5], [])


def test_blocks_make_up_the_range(spark):
    rng = random.Random(1)
    ranges = [(a, a + rng.randint(0, 6000)) for a in (rng.randint(0, 5000) for _ in range(200))] + [(0, 0), (7, 8), (0, 63), (1, 8**5)]
    df = spark.createDataFrame(ranges, "a long, b long").select("a", "b", resolve._covering(F.col("a"), F.col("b")).alias("blocks"))
    for r in df.collect():
        lines = sorted(x for k, b in r.blocks for x in range(b * 8**k, (b + 1) * 8**k))
        assert lines == list(range(r.a, r.b + 1)) and len(r.blocks) <= 14 * 6


def test_a_large_file_with_nested_functions_is_linear(spark):
    """100,000 functions, each inside the one before, and 100,000 references to every depth, in one file."""
    n = 100_000
    fn = spark.range(n).select(F.concat(F.lit("f"), "id").alias("id"), F.lit("a.go").alias("file_path"), F.col("id").alias("start_line"), (2 * n - F.col("id")).alias("end_line"), (n - F.col("id")).alias("ord"))
    refs = spark.range(n).select(F.lit("x").alias("callee_id"), F.lit("a.go").alias("ref_path"), F.col("id").alias("ref_line"))
    began = time.time()
    edges = resolve.resolve_references(refs, fn)
    assert edges.where(F.col("dst") == "x").count() == n
    assert time.time() - began < 120
    assert edges.agg(F.sum(F.substring("src", 2, 20).cast("long"))).first()[0] == n * (n - 1) // 2  # the innermost is the first here


EXT = [".go", ".py", ".js", ".jsx", ".ts", ".tsx", ".java"]


def targets(source, path, files):
    """One import by the rules, file by file."""
    if path.startswith("."):
        base = os.path.normpath(os.path.join(os.path.dirname(source), path))
        base = "" if base == "." else base
        for e in EXT:
            if base + e in files:
                return {base + e}
        if base and any(f.startswith(base + "/") for f in files):
            return {f for f in files if f.startswith(base)}
    segs = [x for x in re.split(r"[./]", path) if x]
    joined = "/".join(segs)
    return {f for f in files if segs and (os.path.dirname(f) in joined if "/" in f else segs[-1] == f.rpartition(".")[0])}


def imports_of(rng, n):
    names = ["a", "b", "lib", "library", "l", "util", "src"]
    path = lambda k: "/".join(rng.choices(names, k=k))
    files = sorted({path(rng.randint(1, 3)) + rng.choice(EXT) for _ in range(40)})
    imports = [(rng.choice(files), rng.choice(["./", "../", "../../", "", "", "x.y."]) + path(rng.randint(1, 3)).replace("/", rng.choice("/."))) for _ in range(n)]
    return files, imports + [(rng.choice(files), p) for p in (".", "..", "./", "", "...", "./lib", "../lib")]


def resolved(spark, imports, files):
    df = resolve.resolve_imports(spark.createDataFrame(imports, "source_path string, path string"), spark.createDataFrame([(f,) for f in files], "path string"))
    rows = [(r.src, r.dst) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_imports_match_brute_force(spark):
    for seed in range(3):
        files, imports = imports_of(random.Random(seed), 150)
        want = {(s, t) for s, p in imports for t in targets(s, p, set(files)) if t != s}
        assert resolved(spark, imports, files) == want


def test_only_affected_sources_change(spark):
    rng = random.Random(9)
    files, imports = imports_of(rng, 200)
    for _ in range(4):
        shift = rng.sample(files, 3)
        left = [f for f in files if f not in shift]
        now = {s: set() for s, _ in imports} | {}
        then = {s: set() for s, _ in imports}
        for s, p in imports:
            now[s] |= targets(s, p, set(files))
            then[s] |= targets(s, p, set(left))
        changed = {s for s in now if now[s] != then[s]}
        got = {r.source_path for r in resolve.affected_sources(spark.createDataFrame(imports, "source_path string, path string"), spark.createDataFrame([(f,) for f in shift], "path string")).collect()}
        assert changed <= got and changed


def test_a_folder_that_many_import_is_spread_and_met_once(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 4)
    files = [f"a/b/m{k}.py" for k in range(40)] + ["a/bc.py", "a/c/x.py", "r.py", "a/b.py"]
    imports = [(f"a/b/m{k}.py", path) for k in range(40) for path in ("..", "../b", "../../a", "pkg.a.b.T", "./m1", "lib/r")]
    def df(ordered=False):
        return resolve.resolve_imports(spark.createDataFrame(imports, "source_path string, path string"), spark.createDataFrame([(f,) for f in files], "path string"), ordered)
    pairs = [(s, t) for s in (f"a/b/m{k}.py" for k in range(40)) for t in files if s != t]  # ".." is a, whose files are all but r.py
    assert sorted(map(tuple, df().collect())) == sorted(pairs)
    assert sorted(map(tuple, df(True).collect())) == sorted(p for p in pairs if p[0].split("/") > p[1].split("/"))
    tasks = df().where("src <> 'r.py' and dst like 'a/b/%'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 2 and max(r["count"] for r in tasks) < 40 * 39 * 0.6
