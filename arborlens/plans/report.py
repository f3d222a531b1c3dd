"""Report, JSON and HTML sinks."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Sequence
from email.utils import formatdate

from pyspark.sql import DataFrame

from ..graph import CodeGraph
from ..operators import health, lookup, walks
from ..schema import CONFIG_DIR


def rows_json(df: DataFrame, limit: int | None = None) -> str:
    """Indented JSON of a result; keys whose value is missing, zero or empty are left out of optional columns."""
    optional = {"start_line", "end_line", "class_name", "title", "from_symbol", "to_symbol"}
    got = (df.limit(limit) if limit else df).collect()
    return json.dumps([{k: v for k, v in r.asDict(recursive=True).items() if v or k not in optional} for r in got], indent=2, ensure_ascii=False)


def audit(graph: CodeGraph, rules: Sequence[tuple[str, str]] = ()) -> dict:
    """Hot spots, cycles, all dead code, metrics and their states."""
    m = health.ai_metrics(graph, rules)
    as_rows = lambda df: [r.asDict() for r in df.collect()]
    return {
        "god_objects": as_rows(health.god_objects(graph)),
        "black_holes": as_rows(health.black_holes(graph)),
        "cycles": as_rows(walks.cycles(graph)),
        "dead_code": as_rows(health.dead_code(graph).orderBy("file_path", "function_name")),
        "metrics": m.first().asDict(),
        "status": as_rows(health.metric_status(m)),
    }


def _cell(x) -> str:
    return str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def _table(head: list[str], rows: list[list], none: str) -> list[str]:
    if not rows:
        return [none, ""]
    return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(map(_cell, r)) + " |" for r in rows), ""]


def markdown(graph: CodeGraph, root: str, rules: Sequence[tuple[str, str]] = (), at: str | None = None) -> str:
    a = audit(graph, rules)
    rel = lambda p: p.removeprefix(root.rstrip("/") + "/")
    out = ["# Code health report", "", f"Made: {at or formatdate(usegmt=True)}", f"Workspace: {_cell(root)}", ""]
    out += ["## 1. Largest classes", "", *_table(["Class", "File", "Contains"], [[r["class_name"], rel(r["file_path"]), r["n"]] for r in a["god_objects"]], "No class contains anything.")]
    out += ["## 2. Most called functions", "", *_table(["Function", "File", "Call sites"], [[r["function_name"], rel(r["file_path"]), r["n"]] for r in a["black_holes"]], "No function is called.")]
    out += ["## 3. Import cycles", "", *([] if not a["cycles"] else ["Files that import themselves over others:", ""]), *_table(["File"], [[rel(r["file_path"])] for r in a["cycles"]], "No import cycle.")]
    out += ["## 4. Unused private functions", "", *_table(["Function", "File"], [[r["function_name"], rel(r["file_path"])] for r in a["dead_code"]], "Every private function is used.")]
    shown = [[s["metric"], f"{s['value']:.0f}" if s["metric"] == "BVI" else f"{100 * s['value']:.2f}%", f"{s['threshold']:.0f}" if s["metric"] == "BVI" else f"{100 * s['threshold']:.2f}%", s["status"]] for s in a["status"]]
    out += ["## 5. Metrics", "", *_table(["Metric", "Value", "Threshold", "Status"], shown, "No metric.")]
    return "\n".join(out)


def graph_html(graph: CodeGraph, root: str) -> str:
    """Write a page with the whole graph to the config folder, row by row; returns its path."""
    path = os.path.join(root, CONFIG_DIR, "arborlens_graph.html")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(os.path.basename(root) or "graph")}</title></head><body>
<input id="q" placeholder="find"><div id="n"></div><script>
const g = """)
        for head, df in (('{"nodes": [', lookup.export_nodes(graph).orderBy("group", "id")), ('], "edges": [', lookup.export_edges(graph).orderBy("from", "to", "label"))):
            f.write(head)
            for k, r in enumerate(df.toLocalIterator()):
                data = json.dumps(r.asDict())
                for c in "<>&\u2028\u2029":
                    data = data.replace(c, f"\\u{ord(c):04x}")
                f.write(f"{', ' if k else ''}{data}")
        f.write("""]};
const show = t => { const box = document.getElementById("n"); box.textContent = "";
  const hits = g.nodes.filter(n => n.label.toLowerCase().includes(t.toLowerCase()));
  if (hits.length > 300) box.textContent = "First 300 of " + hits.length + "; type more to narrow";
  for (const n of hits.slice(0, 300)) {
    const d = document.createElement("details"), s = document.createElement("summary"), p = document.createElement("pre");
    s.textContent = n.group + " " + n.label;
    p.textContent = n.title + "\\n" + g.edges.filter(e => e.from === n.id || e.to === n.id).map(e => e.from + " " + e.label + " " + e.to).join("\\n");
    d.append(s, p); box.append(d); } };
document.getElementById("q").oninput = e => show(e.target.value); show("");
</script></body></html>""")
    os.replace(f"{path}.part", path)
    return path
