"""The report and the page leave no row out."""

import json

from arborlens.graph import CodeGraph
from arborlens.plans import report
from arborlens.service import Workspace

EDGE = "src string, src_type string, dst string, dst_type string, label string"


def wide(spark, n):
    """n private functions in one file; the first n / 2 call the next one."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    fn = [(f"fn:{k:05d}", f"f{k:05d}", "a.py", "", "", 1, 2, False) for k in range(n)]
    edges = [("a.py", "File", r[0], "Function", "CONTAINS") for r in fn] + [(fn[k][0], "Function", fn[k + 1][0], "Function", "CALLS") for k in range(n // 2)]
    return CodeGraph(
        frame([("a.py", "h", 1)], "path string, hash string, last_modified long"),
        frame(fn, "id string, name string, file_path string, docstring string, ast_hash string, start_line long, end_line long, is_exported boolean"),
        frame([], "id string, name string, file_path string, docstring string, type_category string, ast_hash string"),
        frame([], "id string, name string, file_path string, type_hint string"),
        frame(edges, EDGE),
    )


def test_every_unused_function_is_listed(spark):
    text = report.markdown(wide(spark, 500), "w", at="-")
    part = text.split("## 4.")[1].split("## 5.")[0]
    assert [line for line in part.splitlines() if line.startswith("| f")] == [f"| f{k:05d} | a.py |" for k in range(500) if k == 0 or k > 250]


def test_page_and_payload_hold_the_whole_graph(spark, tmp_path, monkeypatch):
    n = 12000
    g = wide(spark, n)
    text = open(report.graph_html(g, str(tmp_path)), encoding="utf-8").read()
    data = json.loads(text.split("const g = ", 1)[1].split(";\nconst show", 1)[0])
    w = Workspace(spark, str(tmp_path))
    monkeypatch.setattr(w, "open", lambda: g)
    for got in (data, w.graph_payload()):
        assert len({r["id"] for r in got["nodes"]}) == len(got["nodes"]) == n + 1
        assert len({(r["from"], r["to"], r["label"]) for r in got["edges"]}) == len(got["edges"]) == n + n // 2
