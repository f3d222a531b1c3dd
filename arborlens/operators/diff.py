"""Snapshot differences over position-independent ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..schema import ALLOWED


def _rel(col, root: str):
    prefix = root.rstrip("/") + "/" if root else ""
    return F.when(col.startswith(prefix), F.substring(col, len(prefix) + 1, 1 << 30)).otherwise(col) if prefix else col


def _typed(graph: CodeGraph, root: str) -> dict[str, DataFrame]:
    """(id, sid, type, name, file_path, content) of each type's nodes."""
    names = graph.classes.select(F.col("id").alias("src"), F.col("name").alias("owner"))
    rel = _rel(F.col("path"), root)
    out = {"File": graph.files.select(F.col("path").alias("id"), rel.alias("sid"), F.lit("File").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"), rel.alias("file_path"), F.col("hash").alias("content"))}
    for t, kind, content in ((graph.functions, "Function", F.col("ast_hash")), (graph.classes, "Class", F.col("ast_hash")), (graph.variables, "Variable", F.lit(None).cast("string"))):
        p = _rel(F.col("file_path"), root)
        if kind == "Class":
            t = t.withColumn("owner", F.lit(None).cast("string"))
        else:  # the class with the largest id, by one row for each owned entity
            last = graph.labelled("CONTAINS", "Class", kind).groupBy(F.col("dst").alias("id")).agg(F.max("src").alias("src"))
            t = t.join(last.join(names, "src").drop("src"), "id", "left")
        out[kind] = t.select("id", F.concat_ws("::", p, "owner", "name").alias("sid"), F.lit(kind).alias("type"), "name", p.alias("file_path"), content.alias("content"))
    return out


def stable_nodes(graph: CodeGraph, root: str = "") -> DataFrame:
    """(id, sid, type, name, file_path, content): sid is the relative path, the class if any, and the name."""
    return reduce(DataFrame.unionByName, _typed(graph, root).values())


def diff_nodes(current: CodeGraph, target: CodeGraph, root: str = "") -> DataFrame:
    """(change, id, type, name, file_path): added, deleted or modified in ``current`` against ``target``.

    A file is modified if its hash differs, a function or class if its structure does, a variable never.
    """
    # Of nodes with one sid the last counts, by type, then by id; both sides meet in one aggregate.
    rank = F.when(F.col("type") == "File", 0).when(F.col("type") == "Function", 1).when(F.col("type") == "Class", 2).otherwise(3)
    row = F.struct(rank.alias("rank"), "id", "type", "name", "file_path", "content")
    sides = stable_nodes(current, root).select("sid", row.alias("a"), F.lit(None).cast("struct<rank:int,id:string,type:string,name:string,file_path:string,content:string>").alias("b"))
    other = stable_nodes(target, root).select("sid", F.lit(None).cast(sides.schema["b"].dataType).alias("a"), row.alias("b"))
    both = sides.unionByName(other).groupBy("sid").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    changed = (F.col("a.type") != "Variable") & (F.coalesce("a.content", F.lit("")) != F.coalesce("b.content", F.lit("")))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(changed, "modified")
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return both.select(change.alias("change"), F.col("sid").alias("id"), pick("type").alias("type"), pick("name").alias("name"), pick("file_path").alias("file_path")).where("change is not null")


def _edges(graph: CodeGraph, root: str) -> dict[tuple, DataFrame]:
    """(from, to) of the edges other than calls, by the kinds that the schema allows; an end that is no node keeps its id."""
    ids, out = _typed(graph, root), {}
    for label, *kinds in ALLOWED:
        if label == "CALLS":
            continue
        e = graph.labelled(label, *kinds).select("src", "dst")
        for side, kind in zip(("src", "dst"), kinds, strict=True):
            if kind != "File" or root:  # a file's id is its path
                e = e.join(ids[kind].select(F.col("id").alias(side), F.col("sid").alias("sid")), side, "left").withColumn(side, F.coalesce("sid", side)).drop("sid")
        out[label, *kinds] = e.select(F.col("src").alias("from"), F.col("dst").alias("to"))
    return out


def diff_edges(current: CodeGraph, target: CodeGraph, root: str = "") -> DataFrame:
    """(change, from, to, type): edges, as a set and without calls, of one side only.

    A kind of edges that both graphs take from the same tables is on both sides: it is read once, and only to take its edges out of
    what is found among the other kinds with its label.
    """
    key, cur, old, out = ["from", "to"], _edges(current, root), _edges(target, root), []
    for label in dict.fromkeys(k[0] for k in cur):
        mine = [k for k in cur if k[0] == label]
        both = [k for k in mine if cur[k].sameSemantics(old[k])]
        sides = [e[k].withColumn("side", F.lit(n)) for k in mine if k not in both for n, e in ((1, cur), (2, old))]
        if not sides:
            continue
        one = reduce(DataFrame.unionByName, sides).groupBy(*key).agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low = high")
        if both:
            shared = reduce(DataFrame.unionByName, [cur[k] for k in both]).toDF("f", "t")
            one = one.join(shared, one["from"].eqNullSafe(shared.f) & one["to"].eqNullSafe(shared.t), "left_anti")
        out.append(one.select(F.when(F.col("low") == 1, "added").otherwise("deleted").alias("change"), *key, F.lit(label).alias("type")))
    if not out:
        return current.files.where("false").select(*[F.lit("").alias(c) for c in ("change", *key, "type")])
    return reduce(DataFrame.unionByName, out)


def match_displayed(nodes: DataFrame, shown: DataFrame) -> DataFrame:
    """For each diff node the displayed one (id, label, group): by id, else the first with its name and type."""
    first = shown.groupBy("label", "group").agg(F.min("id").alias("by_name"))
    own = shown.select(F.col("id").alias("by_id"))
    out = nodes.join(own, nodes.id == own.by_id, "left").join(first, (nodes.name == first.label) & (nodes.type == first.group), "left")
    return out.select(*[nodes[c] for c in nodes.columns], F.coalesce("by_id", "by_name").alias("display_id"))
