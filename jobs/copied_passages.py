"""Incremental report of copied passages: ``python -m jobs.copied_passages jobs/copied_passages.json``.

A passage is a run of ``window`` lines, blank lines left out and white space evened out (a shorter text is one
passage).  The report has, for each source, the passages that stand in it more than once.

New files of documents are taken by a file stream that ends when nothing is left (``availableNow``).  Its
checkpoint says which files have been read, and its file sink writes each batch once, however often a run is
begun again.  The stream appends the digest and place of every passage to ``<output>/passages``, partitioned
by a hash of the source; then ``<output>/report`` is brought up to date: a partition is made anew, by dynamic
overwrite, if it has another number of passages than ``<output>/counted`` says that its report was made from.
A run that was broken off after the stream is thus made good by the next, and a run that finds nothing new
writes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arborlens.sources.ignore import ignored
from arborlens.streaming.files import one_or_many

from .common import command, log, read_or_empty

PASSAGES = "source string, doc_id long, line int, digest binary, part int"
REPORT = "source string, digest string, n_places long, n_docs long, first_doc long, first_line int, part int"
COUNTED = "n long, part int"
SETTINGS = "window int, parts int, ignore string"


def passages(docs: DataFrame, window: int) -> DataFrame:
    """(source, doc_id, line, digest) of each passage of (doc_id, text, source); ``line`` is where it begins, from 1."""
    even = lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "), "^ | $", "")
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), even(x).alias("said")))
    lines = docs.select("source", "doc_id", F.filter(numbered, lambda x: x.said != "").alias("lines")).where("size(lines) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("lines") - (window - 1), F.lit(1)))
    digest = lambda k: F.unhex(F.sha2(F.array_join(F.transform(F.slice("lines", k, F.lit(window)), lambda x: x.said), "\n").cast("binary"), 256))
    found = F.transform(starts, lambda k: F.struct(F.element_at("lines", k).line.alias("line"), digest(k).alias("digest")))
    return lines.select("source", "doc_id", F.inline(found))


def repeated(found: DataFrame) -> DataFrame:
    """The passages that stand in a source more than once, with their first place; counts are added up by document first."""
    each = found.groupBy("part", "source", "digest", "doc_id").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    whole = each.groupBy("part", "source", "digest").agg(F.sum("n").alias("n_places"), F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "line")).alias("first"))
    return whole.where("n_places > 1").select("source", F.lower(F.hex("digest")).alias("digest"), "n_places", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"), "part")


def _take(spark: SparkSession, documents: str, output: str, checkpoint: str, window: int, parts: int, spread: int, files_per_batch: int | None, ignore: Sequence[str]) -> int:
    """Append the passages of the files that have not been read yet; the number of their documents."""
    stream = spark.readStream.schema("doc_id long, text string, source string")
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    docs = stream.parquet(one_or_many(documents))
    if ignore:
        docs = docs.where(~ignored(F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")), list(ignore)))
    found = passages(docs, window).withColumn("part", F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int"))
    # a few tasks write each partition of a batch, a hot source's too, and none writes all partitions
    dealt = found.repartition(F.col("part"), F.pmod(F.xxhash64("doc_id"), F.lit(spread)))
    query = dealt.writeStream.format("parquet").partitionBy("part").option("path", f"{output}/passages").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def _settle(spark: SparkSession, output: str, settings: tuple) -> None:
    """Note what the output is made with, or refuse to go on with something else."""
    known = [tuple(r) for r in read_or_empty(spark, f"{output}/settings", SETTINGS).collect()]
    if known and known != [settings]:
        raise ValueError(f"{output} was begun with window, parts, ignore = {known[0]}, not {settings}")
    if not known:
        spark.createDataFrame([settings], SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{output}/settings")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, window: int = 3, parts: int = 64, spread: int = 8, files_per_batch: int | None = None, ignore: Sequence[str] = ()) -> dict:
    """Take the new files under ``documents`` (Parquet with doc_id, text, source) and bring ``<output>/report`` up to date.

    Null and blank texts have no passages, a null source is a source of its own, an id that comes again is more
    lines of the same document.  ``ignore`` are patterns of ``source/doc_id``, as in an ignore file.  ``window``,
    ``parts`` and ``ignore`` belong to the output: a run with others than it was begun with is an error.
    ``spread`` tasks write a partition of a batch; ``files_per_batch`` bounds what a batch of the stream takes.
    """
    output = output.rstrip("/")
    _settle(spark, output, (window, parts, json.dumps(sorted(ignore))))
    log.info("reading new files of %s (checkpoint %s)", documents, checkpoint)
    docs = _take(spark, documents, output, checkpoint, window, parts, spread, files_per_batch, ignore)
    log.info("read %d new documents, passages are in %s/passages", docs, output)

    found = read_or_empty(spark, f"{output}/passages", PASSAGES)
    now = found.groupBy("part").agg(F.count("*").alias("n"))
    known = read_or_empty(spark, f"{output}/counted", COUNTED).select("part", F.col("n").alias("known"))
    # one row for each partition at most: read once, since `counted` is written from it
    stale = now.join(known, "part", "left").where("known is null or known <> n").select("part", "n").collect()
    done = {"documents": docs, "parts": len(stale), "rows": 0}
    if stale:
        fresh = repeated(found.where(F.col("part").isin([r.part for r in stale])))
        overwrite = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{output}/{name}")
        rows = Observation()
        overwrite(fresh.observe(rows, F.count("*").alias("n")).hint("rebalance", "part"), "report")
        overwrite(spark.createDataFrame([(r.n, r.part) for r in stale], COUNTED).coalesce(1), "counted")
        done["rows"] = rows.get["n"]
    log.info("wrote %d rows of %d partitions to %s/report", done["rows"], done["parts"], output)
    return done


def report(spark: SparkSession, output: str) -> DataFrame:
    return read_or_empty(spark, f"{output.rstrip('/')}/report", REPORT).drop("part")


#: DuckDB SQL for the report over all documents with a window of three lines.
SQL_REPORT = r"""
WITH lines AS (
    SELECT source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {'line': i,
        'said': regexp_replace(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')}), lambda x: x.said <> '') AS lines FROM documents),
found AS (SELECT source, doc_id, unnest(list_transform(range(1, greatest(len(lines) - 2, 1) + 1), lambda k: {'line': lines[k].line,
    'digest': sha256(array_to_string(list_transform(lines[k:k + 2], lambda x: x.said), chr(10)))})) AS p FROM lines WHERE len(lines) > 0)
SELECT source, p.digest AS digest, count(*) AS n_places, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, CAST(arg_min(p.line, [doc_id, p.line]) AS INTEGER) AS first_line
FROM found GROUP BY ALL HAVING count(*) > 1
"""

if __name__ == "__main__":
    command(run, "copied passages")
