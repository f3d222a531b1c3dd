"""Every kind of symbol of the five languages, from texts written out here."""

from pyspark.sql import functions as F

from arborlens.sources.extract import symbols

SOURCES = {
    "a.go": 'package p\n\nimport (\n\t"fmt"\n\tm "os"\n)\n\n// Hello greets.\n// Twice.\nfunc Hello(a int) string { return fmt.Sprint(a) }\n\nfunc other(b int) string { return fmt.Sprint(b) }\n\ntype Box[T any] struct {\n\tval  T\n\tmore []T\n}\n\ntype Shape interface {\n\tArea() float64\n}\n\nfunc (b *Box[T]) Get() T { m.Exit(1); return b.val }\n',
    "A.java": "package p;\nimport java.util.List;\n/** About A. */\npublic class A extends B implements C, D<E> {\n  private int count = 0;\n  A(int x) { count = x; }\n  class Inner {\n    void deep() { int local = 1; }\n  }\n  public List<String> names() { return null; }\n}\ninterface I { void f(); }\nenum Kind { ONE, TWO; int size() { return 2; } }\n",
    "k.ts": "import { x } from './b';\nconst y = require(\"z\"), quote = /\"}/;\nexport class K<T> extends L<T> { go<U>(a: U) { return a; } }\nfunction top<T>(a: T) { function nested() {} return a; }\n",
    "ok.py": "import os, sys\nfrom .x import y\n# About f\ndef f():\n    return 1\nclass A(B):\n    class Deep:\n        def g(self): pass\n",
    "broken.py": "import os\ndef bad(:\n    pass\nclass C:\n    def fine(self):\n        return 1\n    def worse(self:\n        pass\n",
}

#: (kind, name or target, file, first line, last line, type of the parent, comment, exported, category, type hint, functions of one shape)
EXTRACTED = [
    ("import", "fmt", "a.go", None, None, None, "", None, "", "", None),
    ("import", "os", "a.go", None, None, None, "", None, "", "", None),
    ("function", "Hello", "a.go", 10, 10, "File", "Hello greets.\nTwice.", True, "", "", 2),
    ("function", "other", "a.go", 12, 12, "File", "", False, "", "", 2),
    ("class", "Box", "a.go", 14, None, "File", "", None, "struct", "", None),
    ("variable", "val", "a.go", 15, None, "Class", "", None, "", "T", None),
    ("variable", "more", "a.go", 16, None, "Class", "", None, "", "[]T", None),
    ("class", "Shape", "a.go", 19, None, "File", "", None, "struct", "", None),
    ("function", "Get", "a.go", 23, 23, "File", "", True, "", "", 1),
    ("import", "java.util.List", "A.java", None, None, None, "", None, "", "", None),
    ("class", "A", "A.java", 4, None, "File", "* About A.", None, "class", "", None),
    ("implements", "B", "A.java", None, None, None, "", None, "", "", None),
    ("implements", "C", "A.java", None, None, None, "", None, "", "", None),
    ("implements", "D", "A.java", None, None, None, "", None, "", "", None),
    ("variable", "count", "A.java", 5, None, "Class", "", None, "", "int", None),
    ("class", "Inner", "A.java", 7, None, "File", "", None, "class", "", None),
    ("function", "deep", "A.java", 8, 8, "Class", "", True, "", "", 1),
    ("variable", "local", "A.java", 8, None, "Class", "", None, "", "int", None),
    ("function", "names", "A.java", 10, 10, "Class", "", True, "", "", 1),
    ("class", "I", "A.java", 12, None, "File", "", None, "interface", "", None),
    ("function", "f", "A.java", 12, 12, "Class", "", True, "", "", 1),
    ("function", "size", "A.java", 13, 13, "File", "", True, "", "", 1),
    ("import", "./b", "k.ts", None, None, None, "", None, "", "", None),
    ("import", "z", "k.ts", None, None, None, "", None, "", "", None),
    ("variable", "y", "k.ts", 2, None, "File", "", None, "", "", None),
    ("variable", "quote", "k.ts", 2, None, "File", "", None, "", "", None),
    ("class", "K", "k.ts", 3, None, "File", "", None, "class", "", None),
    ("implements", "L", "k.ts", None, None, None, "", None, "", "", None),
    ("function", "go", "k.ts", 3, 3, "Class", "", True, "", "", 1),
    ("function", "top", "k.ts", 4, 4, "File", "", True, "", "", 1),
    ("function", "nested", "k.ts", 4, 4, "File", "", True, "", "", 1),
    ("import", "os", "ok.py", None, None, None, "", None, "", "", None),
    ("import", "sys", "ok.py", None, None, None, "", None, "", "", None),
    ("import", ".x", "ok.py", None, None, None, "", None, "", "", None),
    ("function", "f", "ok.py", 4, 5, "File", "# About f", True, "", "", 1),
    ("class", "A", "ok.py", 6, None, "File", "", None, "class", "", None),
    ("implements", "B", "ok.py", None, None, None, "", None, "", "", None),
    ("class", "Deep", "ok.py", 7, None, "File", "", None, "class", "", None),
    ("function", "g", "ok.py", 8, 8, "Class", "", True, "", "", 1),
    ("import", "os", "broken.py", None, None, None, "", None, "", "", None),
    ("function", "bad", "broken.py", 2, 3, "File", "", True, "", "", 1),
    ("class", "C", "broken.py", 4, None, "File", "", None, "class", "", None),
    ("function", "fine", "broken.py", 5, 6, "Class", "", True, "", "", 1),
    ("function", "worse", "broken.py", 7, 8, "Class", "", True, "", "", 1),
]


def test_symbols_of_written_sources(spark):
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in SOURCES.items()], "path string, content binary")
    rows = symbols(files)
    shapes = rows.where("kind = 'function'").groupBy("ast_hash").agg(F.count("*").alias("alike"))
    rows = rows.join(shapes, "ast_hash", "left").collect()
    place = lambda r: r.parent_type if r.start_line is not None else None
    got = [(r.kind, r.name if r.name is not None else r.target, r.file_path, r.start_line, r.end_line, place(r), r.docstring, r.is_exported, r.type_category, r.type_hint, r.alike if r.kind == "function" else None) for r in rows]
    assert sorted(got, key=str) == sorted(EXTRACTED, key=str)
