"""A substring search index: the trigrams of names and comments, kept beside a snapshot.

A text of three characters or more can only stand in a node that has all of its trigrams.  The postings of these
are read alone, intersected, and what is left is tested with the text itself, so the index never changes a result.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import CodeGraph

N = 3
NODES = "type string, id string, name string, docstring string, file_path string, start_line long, part int"
POSTINGS = "gram string, type string, id string, part int, bucket int"


def _nodes(graph: CodeGraph, parts: int) -> DataFrame:
    none = F.lit(None)
    each = [
        graph.functions.select(F.lit("Function").alias("type"), "id", "name", "docstring", "file_path", "start_line"),
        graph.classes.select(F.lit("Class").alias("type"), "id", "name", "docstring", "file_path", none.cast("long").alias("start_line")),
        graph.variables.select(F.lit("Variable").alias("type"), "id", "name", none.cast("string").alias("docstring"), "file_path", none.cast("long").alias("start_line")),
    ]
    return reduce(DataFrame.unionByName, each).withColumn("part", F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(parts)).cast("int"))


def _grams(text) -> F.Column:
    n = F.coalesce(F.char_length(text), F.lit(0))
    return F.when(n >= N, F.transform(F.sequence(F.lit(1), F.greatest(n - (N - 1), F.lit(1))), lambda k: F.substring(text, k, N))).otherwise(F.array().cast("array<string>"))


def build_index(graph: CodeGraph, path: str, buckets: int = 64) -> None:
    """Write ``<path>/nodes`` and ``<path>/postings``: nodes dealt by their ids, postings by trigrams and sorted by them,
    so that a search reads few folders and, in these, few row groups."""
    nodes = _nodes(graph, buckets)
    nodes.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/nodes")
    stored = graph.functions.sparkSession.read.schema(NODES).parquet(f"{path}/nodes")
    grams = stored.select(F.explode(F.array_distinct(F.concat(_grams(F.col("name")), _grams(F.col("docstring"))))).alias("gram"), "type", "id", "part")
    dealt = grams.withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).cast("int"))
    # by ranges, so that a trigram of a third of all nodes is cut too
    parts = int(graph.functions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartitionByRange(parts, "bucket", "gram", "id").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, text: str, buckets: int = 64) -> DataFrame:
    """(type, id, part) of the nodes that have all trigrams of a text of three characters or more."""
    grams = sorted({text[k : k + N] for k in range(len(text) - N + 1)})
    places = sorted({zlib.crc32(g.encode()) % buckets for g in grams})
    posted = spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("bucket").isin(places) & F.col("gram").isin(grams))
    if len(grams) == 1:
        return posted.select("type", "id", "part")
    return posted.groupBy("type", "id", "part").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("type", "id", "part")


def search_indexed(spark: SparkSession, path: str, text: str, buckets: int = 64) -> DataFrame:
    """(block, type, name, file_path, start_line), as ``lookup.search`` gives them, by the index under ``path``.

    Shorter texts have no trigram: for them every node is tested.
    """
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes")
    if len(text) >= N:
        nodes = nodes.join(candidates(spark, path, text, buckets), ["part", "type", "id"], "left_semi")
    hit = F.col("name").contains(text) | F.coalesce(F.col("docstring").contains(text), F.lit(False))
    block = F.when(F.col("type") == "Function", 1).when(F.col("type") == "Class", 2).otherwise(3)
    return nodes.where(hit).select(block.alias("block"), "type", "name", "file_path", "start_line")
