"""A workspace: build or open its graph, keep it current, and answer the tools' and pages' requests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import CodeGraph
from .operators import diff, health, lookup, walks
from .plans import report
from .schema import CONFIG_DIR, FILES
from .sources.extract import build, symbols
from .sources.workspace import boundary_rules, scan, scan_git, scan_paths
from .store import GraphStore
from .upkeep import LiveGraph


class Workspace:
    """``refs`` (callee_id, ref_path, ref_line) are reference locations from any language tool; without them there are no calls."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None, refs: DataFrame | None = None, read_only: bool = False):
        if os.path.realpath(root) in (os.path.realpath(os.path.expanduser("~")), os.path.abspath(os.sep)):
            raise ValueError("a home or root folder is no workspace")
        self.spark, self.root, self.refs = spark, os.path.abspath(root), refs
        self.store = GraphStore(spark, store or os.path.join(self.root, CONFIG_DIR, "graph"), read_only)

    def _save(self, files: DataFrame, rows: DataFrame) -> CodeGraph:
        version, kept = self.store.stage(rows)
        self.store.save(build(files, self.refs, kept), version)
        self.store.vacuum()
        return self.store.load()

    def reindex(self) -> CodeGraph:
        """Scan, extract and resolve everything; the new version replaces the old one whole."""
        files = scan(self.spark, self.root)
        return self._save(files, symbols(files))

    def open(self, force: bool = False) -> CodeGraph:
        """The stored graph, built first if there is none or ``force`` is set."""
        graph = self.store.load()
        return self.reindex() if force or (not self.store.read_only and graph.is_empty()) else graph

    def update(self, changed: list[str], removed: list[str]) -> CodeGraph:
        """Bring the graph up to date after file events.

        Only the changed files are read and extracted; their rows replace the stored ones.  Relations reach
        over files (an import may now resolve to a new file, a class name to another file's), so they are
        resolved again, as joins over all rows; the result equals a full build.
        """
        old = self.store.symbols()
        if not changed and not removed:
            return self.store.load()
        if old is None:
            return self.reindex()
        fresh = scan_paths(self.spark, self.root, changed)
        touched = self.spark.createDataFrame([(p,) for p in {*changed, *removed}], "path string")
        files = self.store.load().files.join(touched, "path", "left_anti").select(*FILES.names).unionByName(fresh.select(*FILES.names))
        rows = old.join(touched.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(*old.columns).unionByName(symbols(fresh))
        return self._save(files, rows)

    def live(self) -> LiveGraph:
        """The graph that ``refresh`` keeps current, built from the tree if there is none yet."""
        live = LiveGraph(self.spark, os.path.join(self.store.root, "live"))
        if live.table("files").limit(1).isEmpty():
            files = scan(self.spark, self.root)
            _, rows = self.store.stage(symbols(files))  # extracted once
            live.build(files.select(*FILES.names), rows, self.refs)
            self.store.vacuum()
        return live

    def refresh(self, changed: list[str], removed: list[str]) -> CodeGraph:
        """Bring the live graph up to date after file events: only files whose edges may have changed are resolved
        again, and only their partitions are written.  ``follow`` can call it in place of ``update``, which makes a
        new version of the whole graph that readers see at once."""
        live = self.live()
        fresh = scan_paths(self.spark, self.root, changed)
        touched = self.spark.createDataFrame([(p,) for p in {*changed, *removed}], "path string")
        live.update(touched, fresh.select(*FILES.names), symbols(fresh), self.refs)
        return live.graph()

    # The five tools.

    def search_codebase(self, query: str) -> str:
        return report.rows_json(lookup.search(self.open(), query).orderBy("block", "file_path", "name", "start_line").drop("block"))

    def get_call_chain(self, target_function: str, depth: int = 3) -> str:
        rows = walks.call_chain(self.open(), target_function, depth if depth > 0 else 3)
        return report.rows_json(rows.orderBy("caller_file", "caller_name", "callee_file"))

    def get_file_structure(self, file_path: str) -> str:
        return report.rows_json(lookup.file_structure(self.open(), file_path).orderBy("block", "start_line", "name").drop("block"))

    def visualize_codebase(self) -> str:
        return report.graph_html(self.open(), self.root)

    def get_architecture_report(self) -> str:
        return report.markdown(self.open(), self.root, boundary_rules(self.root))

    # The three payloads.

    def graph_payload(self) -> dict:
        """The whole graph, sorted, and its metrics."""
        g = self.open()
        rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).toLocalIterator()]
        return {"nodes": rows(lookup.export_nodes(g), "group", "id"), "edges": rows(lookup.export_edges(g), "from", "to", "label"), "metrics": health.ai_metrics(g, boundary_rules(self.root)).first().asDict()}

    def diff_payload(self, ref: str) -> dict:
        """Changes of the stored graph against a git revision, as five sorted lists."""
        files = scan_git(self.spark, self.root, ref)
        rows = symbols(files).persist()  # extracted once for all tables and edges
        try:
            old = build(files, rows=rows)
            nodes = [r.asDict() for r in diff.diff_nodes(self.open(), old).orderBy("id").collect()]
            edges = [r.asDict() for r in diff.diff_edges(self.open(), old).orderBy("from", "to", "type").collect()]
        finally:
            rows.unpersist()
        pick = lambda rows, c: [{k: v for k, v in r.items() if k != "change"} for r in rows if r["change"] == c]
        return {"added_nodes": pick(nodes, "added"), "deleted_nodes": pick(nodes, "deleted"), "modified_nodes": pick(nodes, "modified"), "added_edges": pick(edges, "added"), "deleted_edges": pick(edges, "deleted")}

    def code_lines(self, function_id: str) -> str | None:
        """The source of one function, what an explanation would be made from."""
        at = lookup.function_range(self.open(), function_id).first()
        if at is None:
            return None
        text = scan(self.spark, self.root).where(F.col("path") == at.file_path).select(lookup.line_slice(F.decode("content", "UTF-8"), F.lit(at.start_line), F.lit(at.end_line)).alias("text")).first()
        return None if text is None else text.text
