import json
import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from arborlens.functions import paths
from arborlens.plans import resolve
from arborlens.service import Workspace
from arborlens.sources.extract import extract
from arborlens.sources.ignore import DEFAULTS, ignored, load_patterns, matcher, read_patterns
from arborlens.sources.workspace import init, scan, scan_git
from arborlens.streaming.live import DirectoryWatch, debounce, debounce_batch

GO = """package main

import (
\t"fmt"
\tm "os"
)

// Hello greets.
// Twice.
func Hello(a int) string { if a > 1 { return fmt.Sprint(a) }; return "x" }

type Thing struct {
\tName string
\tAge int
}

func (t *Thing) do() { m.Exit(1) }

func helper(b int) string { if b > 2 { return fmt.Sprint(b) }; return "yy" }
"""
JAVA = """package p;
import java.util.List;
/** Doc. */
public class A extends B implements C, D {
  private int count = 0;
  public String name(int x) { for (int i = 0; i < x; i++) { go(i); } return ""; }
}
interface I { void f(); }
"""
TS = """import { x } from './b';
const y = require("z");
export class K extends L { size: number; go(a: string) { return a; } }
function top() { const inner = 1; }
"""


def rows(path, text):
    out = extract(text.encode(), path)
    return {k: [r for r in out if r["kind"] == k] for k in ("function", "class", "variable", "import", "implements")}


def test_go():
    r = rows("d/a.go", GO)
    assert [(f["name"], f["is_exported"]) for f in r["function"]] == [("Hello", True), ("do", False), ("helper", False)]
    assert r["function"][0]["docstring"] == "Hello greets.\nTwice."
    assert r["function"][0]["ast_hash"] == rows("b.go", GO.replace("Hello", "Other"))["function"][0]["ast_hash"] != r["function"][1]["ast_hash"]
    assert [(c["name"], c["type_category"]) for c in r["class"]] == [("Thing", "struct")]
    assert [(v["name"], v["type_hint"], v["parent_type"]) for v in r["variable"]] == [("Name", "string", "Class"), ("Age", "int", "Class")]
    assert [i["target"] for i in r["import"]] == ["fmt", "os"]


def test_same_line_same_name():
    r = rows("a.go", "package p\nvar cfg struct { cfg int }\n")["variable"]
    assert len({v["id"] for v in r}) == len(r) >= 1


def test_other_languages():
    r = rows("A.java", JAVA)
    assert [f["name"] for f in r["function"]] == ["name", "f"] and [c["type_category"] for c in r["class"]] == ["class", "interface"]
    assert [i["target"] for i in r["implements"]] == ["B", "C", "D"] and [i["target"] for i in r["import"]] == ["java.util.List"]
    assert [v["name"] for v in r["variable"]] == ["count", "i"]  # a local belongs to the class
    r = rows("a.ts", TS)
    assert [f["name"] for f in r["function"]] == ["go", "top"] and [i["target"] for i in r["import"]] == ["./b", "z"]
    assert [v["name"] for v in r["variable"]] == ["y", "size", "inner"]
    r = rows("m.py", "import os\nfrom .x import y\nclass A(B):\n    # about f\n    def f(self):\n        'doc'\n        return 1\ndef g(): pass\n")
    assert [(f["name"], f["parent_type"], f["docstring"]) for f in r["function"]] == [("f", "Class", "# about f"), ("g", "File", "")]
    assert [i["target"] for i in r["import"]] == ["os", ".x"] and [i["target"] for i in r["implements"]] == ["B"]
    assert [(f["name"], f["start_line"]) for f in rows("b.py", "def broken(")["function"]] == [("broken", 1)]
    with pytest.raises(ValueError):
        extract(b"", "a.kt")


def names(path, text):
    r = rows(path, text)
    return [(x["name"], x["parent_type"]) for x in r["function"]], [(x["name"], x["type_category"]) for x in r["class"]], [(x["name"], x["type_hint"]) for x in r["variable"]], [x["target"] for x in r["implements"]]


def test_go_type_parameters():
    text = "package p\n\ntype Box[T any] struct {\n\tval T\n\tlist []map[string]T\n}\n\ntype Pair[K comparable, V any] interface {\n\tGet(k K) V\n}\n\ntype (\n\t// A is one.\n\tA struct { x int }\n\tB = int\n)\n\nfunc (b *Box[T]) Get() T { return b.val }\nfunc Map[T any, U any](in []T) []U { return nil }\nvar cfg struct { port int }\n"
    functions, classes, variables, _ = names("g.go", text)
    assert functions == [("Get", "File"), ("Map", "File")] and classes == [("Box", "struct"), ("Pair", "struct"), ("A", "struct")]
    assert variables[:3] == [("val", "T"), ("list", "[]map[string]T"), ("x", "int")] and ("port", "int") in variables and ("cfg", "struct") in variables
    assert rows("g.go", text)["class"][2]["docstring"] == "A is one."


def test_java_members():
    text = "package p;\n/** Doc. */\ninterface I<T> extends K<T, L> { void f(); default int g(int x) { return x; } <R> R map(T t); }\nabstract class A implements I<String>, Q {\n  A(int x) { assert f(x); }\n  @Override public abstract String name(int x);\n  protected List<String> list() { return new ArrayList<>() { int size() { return 0; } }; }\n}\nenum E { ONE(1) { int v() { return 1; } }, TWO(2); final int n; E(int n) { this.n = n; } int w() { return n; } }\nrecord P(int a, int b) { int sum() { return a + b; } }\n"
    functions, classes, variables, heritage = names("J.java", text)
    assert functions == [(f, "Class") for f in ("f", "g", "map", "name", "list", "size")] + [(f, "File") for f in ("v", "w", "sum")]
    assert classes == [("I", "interface"), ("A", "class")] and variables == [("n", "int")] and heritage == ["K", "I", "Q"]


def test_typescript_members():
    text = "const re = /ab\"c[/]d/g, q = 4 / 2;\nexport class K<T extends object> extends L<A, B> implements M { go<U>(a: U): T { return a / 2; } delete(k: string) { return 1; } async run() { if (a) { b(); } } }\nfunction id<T>(x: T): T { const inner = 1; return x; }\nexport function plain(a) { return /}/.test(a); }\n"
    functions, classes, variables, heritage = names("t.ts", text)
    assert functions == [("go", "Class"), ("delete", "Class"), ("run", "Class"), ("id", "File"), ("plain", "File")]
    assert classes == [("K", "class")] and heritage == ["L", "M"] and [v for v, _ in variables] == ["re", "q", "inner"]


def test_python_with_errors():
    text = "import os\n# about A\nclass A(B):\n    def ok(self):\n        return 1\n    def broken(self:\n        x = (1\n    @deco\n    def after(self):\n        def inner(): pass\n        return inner\n\ndef top():\n    return 1\ndef bad( :\n    pass\nfrom .x import y\n"
    r = rows("b.py", text)
    assert [(f["name"], f["parent_type"], f["start_line"], f["end_line"]) for f in r["function"]] == [("ok", "Class", 4, 5), ("broken", "Class", 6, 7), ("after", "Class", 9, 11), ("inner", "Class", 10, 10), ("top", "File", 13, 14), ("bad", "File", 15, 16)]
    assert [(c["name"], c["docstring"]) for c in r["class"]] == [("A", "# about A")] and [i["target"] for i in r["import"]] == ["os", ".x"]
    deep = "x = " + "(" * 90 + "1" + ")" * 90 + "\ndef f():\n" + "".join("    " * k + "if a:\n" for k in range(1, 60)) + "    " * 60 + "pass\n"
    assert [f["name"] for f in rows("d.py", deep)["function"]] == ["f"]
    assert [f["name"] for f in rows("e.py", "y = " + "-" * 200_000 + "1\ndef g(): pass\n")["function"]] == ["g"]


def test_ignore(spark, tmp_path):
    def flags(names, patterns):
        df = spark.createDataFrame([(n,) for n in names], "path string").coalesce(1)
        return [r[0] for r in df.select(ignored(F.col("path"), patterns)).collect()]

    names = ["main.go", "node_modules/x.js", "a/vendor/b.go", "x.test", "pkg/x.out", "go.work", "src/builder.go", "tmp/a", "a.coverprofile"]
    assert flags(names, list(DEFAULTS)) == [False, True, True, True, True, True, False, True, True]
    custom = [*DEFAULTS, *read_patterns("# no\n\n*.log\n/tmp-output\ntemp_*\na/b\n")]
    assert flags(["main.go", "app.log", "logs/app.log", "tmp-output/f.txt", "temp_d.json", "src/temp_d.json", "a/b/c.go", "x/a/b.go"], custom) == [False, True, True, True, True, True, True, False]
    assert load_patterns(str(tmp_path)) == list(DEFAULTS) and not list(tmp_path.iterdir())
    init(str(tmp_path))
    init(str(tmp_path))
    (tmp_path / ".arborlens" / "ignore").write_text("second\n")
    assert load_patterns(str(tmp_path)) == list(DEFAULTS)
    (tmp_path / ".arborignore").unlink()
    assert load_patterns(str(tmp_path))[-1] == "second"


def test_resolution(spark):
    imports = lambda *r: spark.createDataFrame(list(r), "source_path string, path string")
    files = lambda *r: spark.createDataFrame([(p,) for p in r], "path string")
    got = lambda i, f, **k: {tuple(r) for r in resolve.resolve_imports(i, f, **k).collect()}
    assert got(imports(("d/a.ts", "./b")), files("d/a.ts", "d/b.js", "d/b.ts")) == {("d/a.ts", "d/b.js")}
    assert got(imports(("m.go", "x/y/z")), files("x/y/q.go", "y/r.go", "w/s.go")) == {("m.go", "x/y/q.go"), ("m.go", "y/r.go")}
    assert got(imports(("m.py", "a.util")), files("util.py", "other.py")) == {("m.py", "util.py")}
    assert got(imports(("d/a.ts", "./lib")), files("d/lib/x.ts", "d/library/y.ts", "e/z.ts")) == {("d/a.ts", "d/lib/x.ts"), ("d/a.ts", "d/library/y.ts")}
    fn = spark.createDataFrame([("outer", "f", 1, 10, 0), ("inner", "f", 3, 5, 1), ("callee", "g", 1, 5, 2)], "id string, file_path string, start_line long, end_line long, ord long")
    refs = spark.createDataFrame([("callee", "f", 4), ("callee", "f", 4), ("callee", "g", 2), ("callee", "f", 99)], "callee_id string, ref_path string, ref_line long")
    assert [tuple(r) for r in resolve.resolve_references(refs, fn).collect()] == [("outer", "callee")] * 2


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/../c/./d.Go", "file:///x%20y/z.py")], "p string, u string")
    r = df.select(paths.join_path(F.lit("/a/b"), F.lit("../c/./d")), paths.extension(F.col("p")), paths.uri_to_path(F.col("u")), paths.uri_to_path(F.lit("http://x")), paths.language(F.col("p")), paths.base_dir(F.lit("a/b.go")), paths.base_dir(F.lit("b.go")), paths.path_to_uri(F.lit("/x y/z"))).first()
    assert tuple(r) == ("/a/c/d", ".go", "/x y/z.py", None, "go", "a", "", "file:///x%20y/z")


@pytest.fixture
def workspace(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("function no() {}")
    (tmp_path / "my.go").write_text("package p\n\nfunc MyFunc() {}\n\ntype MyStruct struct {\n\tField int\n}\n")
    (tmp_path / "sub" / "my.py").write_text("def my_py():\n    pass\n")
    return tmp_path


def test_workspace(spark, workspace):
    w = Workspace(spark, str(workspace))
    assert [(r["type"], r["name"]) for r in json.loads(w.search_codebase("My"))] == [("Function", "MyFunc"), ("Class", "MyStruct")]
    assert json.loads(w.search_codebase("my_py"))[0]["type"] == "Function"
    assert [(r["type"], r["name"]) for r in json.loads(w.get_file_structure("my.go"))] == [("Function", "MyFunc"), ("Class", "MyStruct"), ("Field", "Field")]
    assert w.get_call_chain("MyFunc", 0) == "[]"
    assert w.code_lines("my.go:3:0:MyFunc") == "func MyFunc() {}"
    page = open(w.visualize_codebase(), encoding="utf-8").read()
    assert "MyStruct" in page and "my.go" in page
    assert "## 5. Metrics" in w.get_architecture_report()
    assert {n["id"] for n in w.graph_payload()["nodes"]} >= {"my.go", "sub/my.py"}
    (workspace / "sub" / "my.py").unlink()
    (workspace / "new.go").write_text("package p\nfunc Fresh() {}\n")
    updated = w.update(["new.go", "node_modules/x.js"], ["sub/my.py"])
    assert {r.path for r in updated.files.collect()} == {"my.go", "new.go"}
    kept = {n: sorted(map(str, t.collect())) for n, t in updated.tables().items()}
    assert kept == {n: sorted(map(str, t.collect())) for n, t in w.reindex().tables().items()}
    with pytest.raises(ValueError):
        Workspace(spark, "/")


def test_git_diff(spark, workspace):
    git = lambda *a: subprocess.run(["git", "-C", str(workspace), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    assert {r.path for r in scan_git(spark, str(workspace), "HEAD").collect()} == {r.path for r in scan(spark, str(workspace)).collect()} == {"my.go", "sub/my.py"}
    (workspace / "my.go").write_text("package p\n\nfunc Other() { x() }\n")
    d = Workspace(spark, str(workspace)).diff_payload("HEAD")
    assert {n["id"] for n in d["added_nodes"]} == {"my.go::Other"} and {n["id"] for n in d["modified_nodes"]} == {"my.go"}
    assert "my.go::MyFunc" in {n["id"] for n in d["deleted_nodes"]}
    for bad in ("-x", "a b", "a;b", ""):
        with pytest.raises(ValueError):
            scan_git(spark, str(workspace), bad)


def test_debounce(spark):
    events = spark.createDataFrame([("p", "write", float(t)) for t in (0, 1.0, 2.0, 5.0)] + [("q", "create", 9.0)], "path string, event string, t double").select("path", "event", F.timestamp_seconds("t").alias("ts"))
    for got in (debounce(events), debounce_batch(events)):
        assert sorted((r.path, r.last_ts.second, r.n) for r in got.collect()) == [("p", 2, 3), ("p", 5, 1), ("q", 9, 1)]


def test_directory_stream(spark, tmp_path):
    root, checkpoint = tmp_path / "w", tmp_path / "c"
    root.mkdir()
    (root / "a.go").write_text("package p")
    spark.dataSource.register(DirectoryWatch)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "no.js").write_text("x")
    q = spark.readStream.format("dirwatch").option("path", str(root)).option("quiet", "0").load().writeStream.format("memory").queryName("seen").option("checkpointLocation", str(checkpoint)).start()
    try:
        q.processAllAvailable()
        (root / "b.go").write_text("package p")
        (root / "a.go").unlink()
        q.processAllAvailable()
        assert {(r.path, r.event) for r in spark.table("seen").collect()} == {("a.go", "create"), ("b.go", "create"), ("a.go", "remove")}
    finally:
        q.stop()


def test_only_quiet_files_are_reported(tmp_path):
    from arborlens.streaming.live import _WatchReader

    f = tmp_path / "a.go"
    f.write_text("package p")
    reader = _WatchReader(str(tmp_path), 1500)
    rows, offset = reader.read(reader.initialOffset())
    assert list(rows) == [] and offset == {"seen": {}}
    old = time.time() - 10
    os.utime(f, (old, old))
    rows, offset = reader.read(offset)
    assert [r[:2] for r in rows] == [("a.go", "create")]
    f.write_text("package q")
    rows, again = reader.read(offset)
    assert list(rows) == [] and again == offset  # changed just now
    os.utime(f, (old + 5, old + 5))
    rows, offset = reader.read(again)
    assert [r[:2] for r in rows] == [("a.go", "write")]
    f.unlink()
    rows, offset = reader.read(offset)
    assert [r[:2] for r in rows] == [("a.go", "remove")]


def test_matcher_is_the_column_test(spark):
    patterns = [*DEFAULTS, "*.log", "tmp-output", "temp_*", "a/b", "x[!0-9]y"]
    names = ["main.go", "node_modules/x.js", "a/vendor/b.go", "x.test", "pkg/x.out", "src/builder.go", "tmp/a", "a.coverprofile", "logs/app.log", "temp_d.json", "a/b/c.go", "x/a/b.go", "xzy", "x5y", "q/xzy/r.go"]
    df = spark.createDataFrame([(n,) for n in names], "path string").coalesce(1)
    test = matcher(patterns)
    assert [r[0] for r in df.select(ignored(F.col("path"), patterns)).collect()] == [test(n) for n in names]


def test_follow_keeps_the_graph_current(spark, workspace, tmp_path_factory):
    import time

    from arborlens.streaming.live import follow

    w = Workspace(spark, str(workspace), store=str(tmp_path_factory.mktemp("store")))
    w.open()
    (workspace / "late.go").write_text("package p\nfunc Late() {}\n")
    q = follow(spark, str(workspace), w.update, str(tmp_path_factory.mktemp("checkpoint")))
    try:
        until = time.time() + 60
        while time.time() < until and not w.store.load().has_file("late.go"):
            time.sleep(0.5)
    finally:
        q.stop()
    assert "Late" in w.search_codebase("Late")


def test_old_versions_go(spark, workspace, tmp_path_factory):
    w = Workspace(spark, str(workspace), store=str(tmp_path_factory.mktemp("store")))
    for k in range(4):
        (workspace / "more.go").write_text(f"package p\nfunc More{k}() {{}}\n")
        w.reindex()
    kept = [n for n in os.listdir(w.store.root) if n.startswith("v-")]
    assert len(kept) == 3 and w.store.version() in kept and w.store.vacuum(keep=0) and w.store.load().has_file("more.go")
