"""Bounded walks by counted frontiers: multiplicities are summed, walks are never listed one by one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..plans.shared import written

#: Hubs of one pass over the edges, a multiple of 64, and passes at most; a pass that finds less than a quarter is the last.
HUBS, BATCHES = 256, 8


def clamp(depth: int, low: int = 1, high: int = 5) -> int:
    return max(low, min(high, depth))


def call_chain(graph: CodeGraph, target: str, depth: int = 3, mode: str = "counted") -> DataFrame:
    """Walks of 1 to ``depth`` calls (clamped to 1..5) that end in a function named ``target``.

    (caller_name, caller_file, callee_name, callee_file) names a walk's start and its target.  ``counted``
    adds ``walks``; ``distinct`` gives each start and target once; ``bag`` repeats a row for each walk.
    The frontier holds (node, target, walks), so it is bounded by nodes and targets, not by walks.
    """
    if mode not in ("counted", "distinct", "bag"):
        raise ValueError(mode)
    fn = graph.functions.select("id", "name", "file_path")
    many = written(graph.labelled("CALLS").groupBy("src", "dst").agg(F.count("*").alias("m")), "calls")
    front = fn.where(F.col("name") == target).select(F.col("id").alias("node"), F.col("id").alias("tgt"), F.lit(1).cast("decimal(38,0)").alias("n"))
    found = None
    for _ in range(clamp(depth)):
        step = front.join(many, F.col("node") == F.col("dst"))
        front = step.groupBy(F.col("src").alias("node"), "tgt").agg(F.sum(F.col("n") * F.col("m")).cast("decimal(38,0)").alias("n"))
        found = front if found is None else found.unionAll(front)
    total = found.groupBy("node", "tgt").agg(F.sum("n").cast("long").alias("walks"))
    start = fn.select(F.col("id").alias("node"), F.col("name").alias("caller_name"), F.col("file_path").alias("caller_file"))
    end = fn.select(F.col("id").alias("tgt"), F.col("name").alias("callee_name"), F.col("file_path").alias("callee_file"))
    rows = total.join(start, "node").join(end, "tgt")
    shown = ["caller_name", "caller_file", "callee_name", "callee_file"]
    if mode == "distinct":
        return rows.select(*shown).distinct()
    if mode == "bag":
        return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("walks")))).select(*shown)
    return rows.groupBy(*shown).agg(F.sum("walks").cast("long").alias("walks"))


def _step(edges: DataFrame, masks: DataFrame) -> DataFrame:
    """(way, node, m0, m1 ...): the hubs of the masks, carried over one edge (way, node, next)."""
    words = [c for c in masks.columns if c not in ("way", "node")]
    return edges.join(masks, ["way", "node"]).groupBy("way", F.col("next").alias("node")).agg(*[F.bit_or(c).alias(c) for c in words])


def _through_hubs(e: DataFrame, hubs: DataFrame, left: DataFrame, depth: int) -> DataFrame:
    """(src) of the nodes ``left`` that lie on a closed walk of at most ``depth`` edges through some hub (pos, node).

    A node that hubs reach in half of the steps, and that reaches one of them in the other half, is on one.  The
    hubs of a node are bits of a few numbers, so a step costs a row for each edge, however many hubs there are.
    """
    words = [f"m{k}" for k in range(HUBS // 64)]
    both = e.select(F.lit(0).alias("way"), F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(e.select(F.lit(1).alias("way"), F.col("dst").alias("node"), F.col("src").alias("next")))
    bit = F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")
    one = hubs.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), "node", *[F.when(F.floor(F.col("pos") / 64) == k, bit).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(words)])
    merged = lambda a, b: a.unionByName(b).groupBy("way", "node").agg(*[F.bit_or(w).alias(w) for w in words])
    reached = [written(_step(both, one), "reached")]  # in 1, 2 ... steps at most
    while len(reached) < depth // 2:
        reached.append(written(merged(reached[0], _step(both, reached[-1])), "reached"))
    short = long = reached[-1].join(left.toDF("node"), "node", "left_semi")
    if depth % 2:  # the longer half ends at nodes that are left alone
        long = merged(short, _step(both.join(left.toDF("next"), "next", "left_semi"), reached[-1]))
    kinds = [(half, way) for half in ("short", "long") for way in (0, 1)]
    rows = short.withColumn("half", F.lit("short")).unionByName(long.withColumn("half", F.lit("long")))
    met = rows.groupBy("node").agg(*[F.bit_or(F.when((F.col("half") == half) & (F.col("way") == way), F.col(w)).otherwise(F.lit(0).cast("long"))).alias(f"{half}{way}{w}") for half, way in kinds for w in words])
    meets = lambda w: F.col(f"long0{w}").bitwiseAND(F.col(f"short1{w}")).bitwiseOR(F.col(f"short0{w}").bitwiseAND(F.col(f"long1{w}"))) != 0
    return met.where(reduce(lambda x, y: x | y, [meets(w) for w in words])).select(F.col("node").alias("src"))


def cyclic_files(graph: CodeGraph, depth: int = 5) -> DataFrame:
    """(file_path) of every file on a closed walk of 1 to ``depth`` imports, once each.

    Files that only import or are only imported go first; the others are numbered.  Walks of two imports are closed
    by an edge that meets its own reverse, which makes no pairs.  While many files are left, those on a walk through
    some hub, a file with many imports both ways, are found for all of them at once.  Longer walks are followed for
    the files that are still left alone: what a file reaches in two or three steps meets what reaches it in one or
    two, so no walk is followed for more than three steps, and a file that has come back is followed no further.
    Edges and what each length has found are written to the shared folder; where no file is left, no longer walk is
    looked for.
    """
    depth = clamp(depth)
    paths = written(graph.labelled("IMPORTS", "File", "File").select("src", "dst").distinct(), "imports")
    nodes = written(paths.select(F.col("src").alias("path")).intersect(paths.select(F.col("dst").alias("path"))).withColumn("id", F.monotonically_increasing_id()), "files")
    for end in ("src", "dst"):
        paths = paths.join(nodes.toDF(end, f"{end}_id"), end)
    e = written(paths.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), "edges")
    found = e.where("src = dst").select("src")
    if depth > 1:
        found = found.unionByName(e.join(e.toDF("dst", "src"), ["src", "dst"], "left_semi").select("src")).distinct()
    if depth > 2:
        found = written(found, "cyclic")
        rest = lambda: nodes.select(F.col("id").alias("src")).join(found, "src", "left_anti")
        many, batch = rest().count(), 0
        if many > HUBS:
            ranked = e.groupBy(F.col("src").alias("node")).count().join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")), "node").orderBy(F.desc(F.col("count") * F.col("n")), "node").limit(HUBS * BATCHES)
            ranked = written(ranked.agg(F.sort_array(F.collect_list(F.struct((-F.col("count") * F.col("n")).alias("by"), "node"))).alias("all")).select(F.posexplode("all")).select("pos", F.col("col.node").alias("node")), "hubs")
        while many > HUBS and batch < BATCHES:
            hubs = ranked.where(F.floor(F.col("pos") / HUBS) == batch).withColumn("pos", F.col("pos") % HUBS)
            found = written(found.unionByName(_through_hubs(e, hubs, rest(), depth)), "cyclic")
            had, many, batch = many, rest().count(), batch + 1
            if many > had * 3 / 4:
                break
        # (start, node): what a start reaches, and what reaches it
        after = e.join(found, "src", "left_anti").toDF("start", "node")
        before = e.join(found.toDF("dst"), "dst", "left_anti").select(F.col("dst").alias("start"), F.col("src").alias("node"))
        for length in range(3, depth + 1):
            if before.isEmpty():
                break
            if length == 4:
                before = written(before.join(e.toDF("next", "node"), "node").select("start", F.col("next").alias("node")).distinct(), "before")
            else:
                after = written(after.join(e.toDF("node", "next"), "node").select("start", F.col("next").alias("node")).distinct(), "after")
            met = written(after.join(before, ["start", "node"], "left_semi").select("start").distinct(), "met")
            found = found.unionByName(met.toDF("src"))
            after, before = after.join(met, "start", "left_anti"), before.join(met, "start", "left_anti")
    return found.distinct().join(nodes.toDF("file_path", "src"), "src").select("file_path")


def cycles(graph: CodeGraph, limit: int = 5) -> DataFrame:
    """The first ``limit`` cyclic files by path."""
    return cyclic_files(graph).orderBy("file_path").limit(limit)
