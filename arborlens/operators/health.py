"""Hot spots, dead code, clones, architecture boundaries and health metrics."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph


def god_objects(graph: CodeGraph, limit: int = 10) -> DataFrame:
    """(class_name, file_path, n): classes by contained entities; same-named classes of a file count together."""
    c = graph.classes.select(F.col("id").alias("src"), F.col("name").alias("class_name"), "file_path")
    n = graph.labelled("CONTAINS", "Class").join(c, "src").groupBy("class_name", "file_path").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "class_name", "file_path").limit(limit)


def black_holes(graph: CodeGraph, limit: int = 10) -> DataFrame:
    """(function_name, file_path, n): functions by call sites."""
    sites = graph.labelled("CALLS").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k"))
    n = sites.join(graph.functions.select("id", F.col("name").alias("function_name"), "file_path"), "id").groupBy("function_name", "file_path").agg(F.sum("k").alias("n"))
    return n.orderBy(F.desc("n"), "function_name", "file_path").limit(limit)


def dead_code(graph: CodeGraph) -> DataFrame:
    """(function_name, file_path) of functions neither exported nor called."""
    called = graph.labelled("CALLS").select(F.col("dst").alias("id"))
    return graph.functions.where(~F.col("is_exported")).join(called, "id", "left_anti").select(F.col("name").alias("function_name"), "file_path")


def _hashed(graph: CodeGraph) -> DataFrame:
    return graph.functions.where("ast_hash is not null and ast_hash <> ''")


def clone_members(graph: CodeGraph) -> DataFrame:
    """(ast_hash, name, file_path, start_line) of functions that share their structure with another."""
    groups = _hashed(graph).groupBy("ast_hash").agg(F.count("*").alias("k")).where("k > 1").select("ast_hash")
    return _hashed(graph).join(groups, "ast_hash", "left_semi").select("ast_hash", "name", "file_path", "start_line")


def clone_groups(graph: CodeGraph) -> DataFrame:
    """(ast_hash, functions): members in order; a group is one row of the result."""
    return clone_members(graph).groupBy("ast_hash").agg(F.sort_array(F.collect_list(F.struct("file_path", "start_line", "name"))).alias("functions"))


def boundary_violations(graph: CodeGraph, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """One row for each edge and rule (from, to) whose substrings the ends' paths contain.

    Rules are configuration, one constant of the plan.  They are matched with nodes, before edges are joined:
    each function or file carries the numbers of the rules whose sides it matches, and an edge breaks the rules
    that its ends have in common.  So the cost of the rules does not grow with the edges.
    """
    shown = ["type", "from_path", "from_symbol", "to_path", "to_symbol"]
    table = F.from_json(F.lit(json.dumps([{"k": k, "a": a, "b": b} for k, (a, b) in enumerate(rules)])), "array<struct<k:int,a:string,b:string>>")
    sides = lambda path: (F.transform(F.filter(table, lambda r: path.contains(r[x])), lambda r: r.k) for x in "ab")

    def ends(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of nodes (id, path, symbol) those that some rule's first side matches, and those that its second does."""
        a, b = sides(F.col("path"))
        return nodes.select(F.col("id").alias("src"), F.col("path").alias("from_path"), F.col("symbol").alias("from_symbol"), a.alias("from_rules")).where("size(from_rules) > 0"), nodes.select(
            F.col("id").alias("dst"), F.col("path").alias("to_path"), F.col("symbol").alias("to_symbol"), b.alias("to_rules")
        ).where("size(to_rules) > 0")

    src, dst = ends(graph.functions.select("id", F.col("file_path").alias("path"), F.col("name").alias("symbol")))
    both = lambda df, kind: df.select(F.lit(kind).alias("type"), *shown[1:], F.explode(F.array_intersect("from_rules", "to_rules")).alias("k"))
    calls = both(graph.labelled("CALLS").select("src", "dst").join(src, "src").join(dst, "dst"), "CALL")
    a, _ = sides(F.col("src"))
    _, b = sides(F.col("dst"))
    none = F.lit(None).cast("string")
    imports = graph.labelled("IMPORTS", "File", "File").select(F.col("src").alias("from_path"), none.alias("from_symbol"), F.col("dst").alias("to_path"), none.alias("to_symbol"), a.alias("from_rules"), b.alias("to_rules"))
    rule = F.element_at(table, F.col("k") + 1)
    return calls.unionByName(both(imports, "IMPORT")).select(*shown, F.concat(rule.a, F.lit(" -> "), rule.b).alias("rule_violated"))


def stats(graph: CodeGraph) -> DataFrame:
    """One row: functions, classes, interfaces, concrete classes."""
    c = graph.classes.agg(F.count("*").alias("classes"), F.count_if(F.col("type_category") == "interface").alias("interfaces"), F.count_if(F.col("type_category").isin("class", "struct")).alias("concrete"))
    return graph.functions.agg(F.count("*").alias("functions")).crossJoin(c)


def ai_metrics(graph: CodeGraph, rules: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """One row: clone, dead-code and interface ratios (SCR, DCR, AOI; 0 over nothing), violations (BVI), counts."""
    parts = stats(graph)
    for df, name in ((clone_members(graph), "cloned"), (dead_code(graph), "dead"), (boundary_violations(graph, rules), "BVI")):
        parts = parts.crossJoin(df.agg(F.count("*").alias(name)))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return parts.withColumns({"SCR": ratio("cloned", "functions"), "DCR": ratio("dead", "functions"), "AOI": ratio("interfaces", "concrete")})


#: A metric above its threshold is in danger.
THRESHOLDS = {"SCR": 0.10, "DCR": 0.05, "BVI": 0, "AOI": 0.50}


def metric_status(metrics: DataFrame) -> DataFrame:
    """(metric, value, threshold, status): strictly above the threshold is Danger, else Pass."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for m, t in THRESHOLDS.items()])
    return metrics.select(F.inline(rows)).withColumn("status", F.when(F.col("value") > F.col("threshold"), "Danger").otherwise("Pass"))
