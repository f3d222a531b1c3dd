"""Search, file outlines, point lookups and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph


def _none(kind: str):
    return F.lit(None).cast(kind)


def search(graph: CodeGraph, text: str) -> DataFrame:
    """(block, type, name, file_path, start_line): case-sensitive substring of a function's or class's name or
    docstring, or of a variable's name.  The empty text matches every non-null one."""
    hit = lambda *cols: reduce(lambda a, b: a | b, (F.col(c).contains(text) for c in cols))
    f = graph.functions.where(hit("name", "docstring")).select(F.lit(1).alias("block"), F.lit("Function").alias("type"), "name", "file_path", "start_line")
    c = graph.classes.where(hit("name", "docstring")).select(F.lit(2).alias("block"), F.lit("Class").alias("type"), "name", "file_path", _none("long").alias("start_line"))
    v = graph.variables.where(hit("name")).select(F.lit(3).alias("block"), F.lit("Variable").alias("type"), "name", "file_path", _none("long").alias("start_line"))
    return f.unionByName(c).unionByName(v)


def file_structure(graph: CodeGraph, path: str) -> DataFrame:
    """(block, type, name, class_name, start_line, end_line) of what a file contains, methods and fields last."""
    top = graph.labelled("CONTAINS", "File").where(F.col("src") == path)
    none = _none("string").alias("class_name")
    lines = [_none("long").alias("start_line"), _none("long").alias("end_line")]
    fn = graph.functions.select(F.col("id").alias("dst"), "name", "start_line", "end_line")
    cl = graph.classes.select(F.col("id").alias("dst"), "name")
    va = graph.variables.select(F.col("id").alias("dst"), "name")
    of = lambda kind: top.where(F.col("dst_type") == kind).select("dst")
    named = lambda k, t: [F.lit(k).alias("block"), F.lit(t).alias("type"), "name"]
    owners = of("Class").join(cl, "dst").select(F.col("dst").alias("src"), F.col("name").alias("class_name"))
    inner = graph.labelled("CONTAINS", "Class").join(owners, "src")
    return reduce(
        DataFrame.unionByName,
        [
            of("Function").join(fn, "dst").select(*named(1, "Function"), none, "start_line", "end_line"),
            of("Class").join(cl, "dst").select(*named(2, "Class"), none, *lines),
            of("Variable").join(va, "dst").select(*named(3, "Variable"), none, *lines),
            inner.where("dst_type = 'Function'").select("dst", "class_name").join(fn, "dst").select(*named(4, "Method"), "class_name", "start_line", "end_line"),
            inner.where("dst_type = 'Variable'").select("dst", "class_name").join(va, "dst").select(*named(5, "Field"), "class_name", *lines),
        ],
    )


def function_range(graph: CodeGraph, function_id: str) -> DataFrame:
    """(file_path, start_line, end_line) of one function; no row if it does not exist."""
    return graph.functions.where(F.col("id") == function_id).select("file_path", "start_line", "end_line")


def line_slice(text, start, end):
    """Lines start to end of a text column, 1-based and inclusive; beyond the end nothing."""
    lines = F.split(text, "\n", -1)
    first = F.greatest(F.lit(1), start)
    return F.when(end < first, "").otherwise(F.array_join(F.slice(lines, first, F.greatest(F.lit(0), end - first + 1)), "\n"))


def export_nodes(graph: CodeGraph) -> DataFrame:
    """(id, label, group, title) of every node for display."""
    named = lambda t, kind, title: t.select("id", F.col("name").alias("label"), F.lit(kind).alias("group"), title.alias("title"))
    doc = lambda kind: F.concat(F.lit(f"{kind}: "), "name", F.when(F.coalesce("docstring", F.lit("")) != "", F.concat(F.lit("\n"), "docstring")).otherwise(""))
    f = graph.files.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), F.lit("File").alias("group"), F.concat(F.lit("File: "), "path").alias("title"))
    return reduce(DataFrame.unionByName, [f, named(graph.functions, "Function", doc("Function")), named(graph.classes, "Class", doc("Class")), named(graph.variables, "Variable", F.concat(F.lit("Variable: "), "name", F.lit(" ("), F.coalesce("type_hint", F.lit("")), F.lit(")")))])


def export_edges(graph: CodeGraph) -> DataFrame:
    return graph.edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "label")
