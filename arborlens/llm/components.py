"""Connected components of an edge DataFrame by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, any order, repeats and loops allowed -> ``(node, component)``.

    ``component`` is the smallest node of the component; only nodes with an edge appear.  No edges: an
    empty result.  Each round replaces a node's neighbours' edges by edges to its smallest neighbour, first
    towards larger nodes, then towards smaller ones (Kiveris et al., 2014); minima are aggregates with
    partial sums and never gather a neighbourhood.  It goes on until nothing changes, which takes a
    logarithmic number of rounds in practice; every round is written to the shared folder, so lineage stays
    short, and adaptive execution splits the rows of a hub when they are joined to its minimum.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("x"), F.col("m").alias("y"), "u")
        e = written(
            small.select(F.col("x").alias("u"), F.col("y").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "cc",
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
