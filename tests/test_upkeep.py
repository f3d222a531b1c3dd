"""Random edits of a small tree: an incremental graph equals a full build, and untouched partitions stay as they are."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from arborlens.schema import FILES
from arborlens.sources.extract import ROWS, build
from arborlens.upkeep import LiveGraph

REFS = "callee_id string, ref_path string, ref_line long"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def row(**x):
    return tuple(x.get(c) for c in COLUMNS)


def content(rng, path):
    """The rows of one version of a file: imports, classes that extend others, functions at places that move."""
    folder = path.rpartition("/")[0]
    out = []
    for _ in range(rng.randint(0, 2)):
        target = rng.choice(["./f1", "./f2", "../b", "..", "a.b", "pkg.a.X", "f3", "./b/f1", "../a/f2"])
        out.append(row(kind="import", file_path=path, target=target))
    for k in range(rng.randint(0, 2)):
        out.append(row(kind="class", id=f"{path}:c{k}", name=f"K{rng.randrange(5)}", file_path=path, docstring="", type_category="class", ast_hash="h", parent_id=path, parent_type="File"))
        out.append(row(kind="implements", file_path=path, parent_id=f"{path}:c{k}", target=f"K{rng.randrange(5)}"))
    at = 1
    for k in range(rng.randint(0, 2)):
        at += rng.randint(0, 3)
        out.append(row(kind="function", id=f"{path}:{at}:f{k}", name=f"f{k}", file_path=path, start_line=at, end_line=at + 4, docstring=folder, ast_hash="h", is_exported=True, parent_id=path, parent_type="File", ord=k))
        at += 5
    return out


def refs_of(tree):
    """Each function is used on one line of every file whose name ends in the same digit."""
    ids = [(r[COLUMNS.index("id")], p) for p, rows in tree.items() for r in rows if r[0] == "function"]
    return [(i, q, 3 + len(p) % 7) for i, p in ids for q in tree if q[-4] == p[-4]]


def shown(graph):
    return {n: Counter(map(str, t.collect())) for n, t in graph.tables().items()}


def test_random_edits_equal_full_builds(spark, tmp_path):
    rng = random.Random(21)
    names = [f"{d}f{k}.py" for d in ("", "a/", "b/", "a/b/", "ab/") for k in range(1, 4)]
    tree = {p: content(rng, p) for p in rng.sample(names, 9)}
    live = LiveGraph(spark, f"file://{tmp_path}/g", 5)
    files = lambda paths: spark.createDataFrame([(p, str(hash(str(tree[p]))), 7) for p in paths if p in tree], FILES)
    rows = lambda paths: spark.createDataFrame([r for p in paths for r in tree.get(p, ())], ROWS)
    refs = lambda: spark.createDataFrame(refs_of(tree), REFS)
    live.build(files(tree), rows(tree), refs())
    assert shown(live.graph()) == shown(build(files(tree), refs(), rows(tree)))
    for step in range(4):
        changed = rng.sample(names, rng.randint(1, 3))
        for p in changed:
            if p in tree and rng.random() < 0.4:
                del tree[p]
            else:
                tree[p] = content(rng, p)
        asked = spark.createDataFrame([(p,) for p in [*changed, *changed]], "path string")
        live.update(asked, files(changed), rows(changed), refs())
        assert shown(live.graph()) == shown(build(files(tree), refs(), rows(tree))), step
        if step == 2:  # the same again: nothing changes
            live.update(asked, files(changed), rows(changed), refs())
            assert shown(live.graph()) == shown(build(files(tree), refs(), rows(tree)))
    for p in list(tree):
        del tree[p]
    live.update(spark.createDataFrame([(p,) for p in names], "path string"), files([]), rows([]), refs() if tree else spark.createDataFrame([], REFS))
    assert all(not c for c in shown(live.graph()).values())


@pytest.mark.parametrize("kept", [True, False])
def test_one_changed_file_rewrites_its_partitions_only(spark, tmp_path, kept):
    rng = random.Random(5)
    paths = [f"d{k}/f.py" for k in range(60)]
    rows = {p: [row(kind="function", id=f"{p}:f", name="f", file_path=p, start_line=1, end_line=5, ord=0, parent_id=p, parent_type="File"), row(kind="import", file_path=p, target=f"d{rng.randrange(60)}")] for p in paths}
    live = LiveGraph(spark, str(tmp_path / "g"), 16)
    files = lambda ps: spark.createDataFrame([(p, "h", 1) for p in ps], FILES)
    live.build(files(paths), spark.createDataFrame([r for p in paths for r in rows[p]], ROWS))
    seen = lambda: {str(p): p.stat().st_mtime_ns for p in Path(tmp_path / "g").rglob("bucket=*/*.parquet")}
    before = seen()
    there = [paths[7]] if kept else []
    new = [row(kind="import", file_path=paths[7], target="d3")] if kept else []
    written = live.update(spark.createDataFrame([(paths[7],)], "path string"), files(there), spark.createDataFrame(new, ROWS))
    bucket = spark.createDataFrame([(paths[7],)], "path string").select(F.pmod(F.xxhash64("path"), F.lit(16))).first()[0]
    assert written["rows"] == written["files"] == written["heritage"] == written["calls"] == [bucket]
    assert written["imports"] == [bucket] if kept else bucket in written["imports"] and len(written["imports"]) < 8
    after = seen()
    touched = {(n, f"bucket={b}") for n, bs in written.items() for b in bs}
    assert {(Path(p).parts[-3], Path(p).parts[-2]) for p in before.keys() - after.keys()} == touched
    assert all(after[p] == before[p] for p in before.keys() & after.keys())


def test_an_update_that_was_broken_off_is_made_good(spark, tmp_path, monkeypatch):
    live = LiveGraph(spark, str(tmp_path / "g"), 4)
    first = {"a.py": [row(kind="import", file_path="a.py", target="./b")], "c.py": [row(kind="import", file_path="c.py", target="./b")]}
    files = lambda ps: spark.createDataFrame([(p, "h", 1) for p in ps], FILES)
    rows = lambda t: spark.createDataFrame([r for rs in t.values() for r in rs], ROWS)
    live.build(files(first), rows(first))
    new = {"b.py": [row(kind="class", id="b.py:c", name="B", file_path="b.py", parent_id="b.py", parent_type="File")]}
    change = (spark.createDataFrame([("b.py",)], "path string"), files(new), rows(new))
    write = LiveGraph._write

    def broken(self, name, df, buckets):
        if name == "files":
            raise RuntimeError("power cut")
        write(self, name, df, buckets)

    monkeypatch.setattr(LiveGraph, "_write", broken)
    with pytest.raises(RuntimeError):
        live.update(*change)
    monkeypatch.setattr(LiveGraph, "_write", write)
    live.update(*change)
    assert shown(live.graph()) == shown(build(files({**first, **new}), None, rows({**first, **new})))
    assert live.update(spark.createDataFrame([], "path string"), files([]), rows({})) == {}


def test_a_workspace_is_refreshed(spark, tmp_path):
    from arborlens.service import Workspace
    from arborlens.sources.workspace import scan

    root = tmp_path / "w"
    (root / "lib").mkdir(parents=True)
    (root / "a.py").write_text("import lib.b\nclass A(B):\n    pass\n")
    (root / "lib" / "b.py").write_text("class B:\n    def go(self):\n        return 1\n")
    w = Workspace(spark, str(root), store=str(tmp_path / "store"))
    assert shown(w.live().graph()) == shown(build(scan(spark, str(root))))
    (root / "lib" / "c.py").write_text("from . import b\nclass C(A):\n    pass\n")
    (root / "a.py").unlink()
    assert shown(w.refresh(["lib/c.py"], ["a.py"])) == shown(build(scan(spark, str(root))))


def test_tables_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path, monkeypatch):
    from arborlens import upkeep

    spark.range(1000).write.parquet(str(tmp_path / "t"))
    plans, write = [], upkeep.LiveGraph._write

    def noted(self, name, df, buckets):
        t = spark.read.parquet(str(tmp_path / "t"))
        plans.append(t.join(t.withColumn("x", t.id), "id")._jdf.queryExecution().sparkPlan().toString())
        write(self, name, df, buckets)

    monkeypatch.setattr(upkeep.LiveGraph, "_write", noted)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    live = upkeep.LiveGraph(spark, str(tmp_path / "live"), 2)
    live.build(spark.createDataFrame([("a.py", "h", 1)], upkeep.FILES), spark.createDataFrame([], upkeep.ROWS))
    assert len(plans) == 5 and not any("Broadcast" in p for p in plans)
    assert [spark.conf.get(k, None) for k in keys] == before


def test_pairs_of_imports_are_made_when_read_and_rows_are_shuffled_once(spark, tmp_path, monkeypatch):
    live, paths = LiveGraph(spark, str(tmp_path / "g"), 2), [f"a/m{k}.py" for k in range(60)]
    files = lambda ps: spark.createDataFrame([(p, "h", 1) for p in ps], FILES)
    pairs = lambda: sorted((r.src, r.dst) for r in live.graph().edges.where("label = 'IMPORTS'").collect())
    stored = lambda: spark.read.parquet(str(tmp_path / "g" / "imports")).where("src is not null").count()
    live.build(files(paths), spark.createDataFrame([row(kind="import", file_path=p, target="../a") for p in paths], ROWS))
    assert pairs() == sorted((s, t) for s in paths for t in paths if s != t) and stored() == len(paths)
    plans, put = [], LiveGraph._put

    def noted(self, df, path, mode):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        put(self, df, path, mode)

    monkeypatch.setattr(LiveGraph, "_put", noted)
    live.update(spark.createDataFrame([("a/x.py",)], "path string"), files(["a/x.py"]), spark.createDataFrame([], ROWS))
    assert pairs() == sorted((s, t) for s in paths for t in [*paths, "a/x.py"] if s != t) and stored() == len(paths)
    # rows and files ahead, three kinds of edges, then rows and files as they are
    assert [p.count("Exchange") for p in plans] == [2] * 5 + [0] * 2
