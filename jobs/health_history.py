"""History of architecture findings: ``python -m jobs.health_history jobs/health_history.json``.

Reads the tables as a code graph and runs the health operators; what they find is one table of findings,
partitioned by the date they hold for.  Each finding says whether it is new since the last date before, known
from it, or gone; so a team sees what a week has brought and not the whole list again.  A date that is run
again is replaced by dynamic overwrite, and no other date is touched.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arborlens.graph import CodeGraph
from arborlens.operators import health, walks
from arborlens.plans.star import load

from .common import command, log, read_or_empty

FINDINGS = "finding string, subject string, file_path string, detail string, value double, status string, as_of string"
KEY = ["finding", "subject", "file_path", "detail"]


def findings(graph: CodeGraph, rules: Sequence[tuple[str, str]], limit: int) -> DataFrame:
    """(finding, subject, file_path, detail, value): god objects and black holes (the ``limit`` largest), uncalled
    functions, clone groups (with their first file), boundary violations, files on import cycles, health metrics."""
    none = F.lit(None).cast("string")

    def kind(df: DataFrame, name: str, subject, path, detail, value) -> DataFrame:
        return df.select(F.lit(name).alias("finding"), subject.alias("subject"), path.alias("file_path"), detail.alias("detail"), value.cast("double").alias("value"))

    c, n = F.col, F.col("n")
    unused = health.dead_code(graph).groupBy("function_name", "file_path").agg(F.count("*").alias("n"))
    clones = health.clone_members(graph).groupBy("ast_hash").agg(F.count("*").alias("n"), F.min("file_path").alias("file_path"))
    crossed = health.boundary_violations(graph, rules).groupBy("rule_violated", "from_path", "to_path").agg(F.count("*").alias("n"))
    metrics = health.metric_status(health.ai_metrics(graph, rules))
    return reduce(
        DataFrame.unionByName,
        [
            kind(health.god_objects(graph, limit), "god object", c("class_name"), c("file_path"), none, n),
            kind(health.black_holes(graph, limit), "black hole", c("function_name"), c("file_path"), none, n),
            kind(unused, "uncalled function", c("function_name"), c("file_path"), none, n),
            kind(clones, "clone group", c("ast_hash"), c("file_path"), none, n),
            kind(crossed, "boundary violation", c("rule_violated"), c("from_path"), c("to_path"), n),
            kind(walks.cyclic_files(graph), "import cycle", c("file_path"), c("file_path"), none, F.lit(1)),
            kind(metrics, "metric", c("metric"), none, c("status"), F.round("value", 6)),
        ],
    )


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """``now`` with ``status``: new, known, or gone for what only ``before`` has (with its old value)."""
    sides = [df.groupBy(*KEY).agg(F.max("value").alias(f"{name}_value")) for df, name in ((now, "new"), (before, "old"))]
    # null parts of a key are equal to each other
    keys = [F.concat(F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("-"))).alias(f"_{k}") for k in KEY]
    a, b = (s.select(*keys, *([F.struct(*KEY).alias(f"{name}_key"), f"{name}_value"])) for s, name in zip(sides, ("new", "old"), strict=True))
    both = a.join(b, [f"_{k}" for k in KEY], "full")
    key = F.coalesce("new_key", "old_key")
    status = F.when(F.col("new_key").isNull(), "gone").when(F.col("old_key").isNull(), "new").otherwise("known")
    return both.select(*[key.getField(k).alias(k) for k in KEY], F.coalesce("new_value", "old_value").alias("value"), status.alias("status"))


def run(spark: SparkSession, tables: str, output: str, as_of: str, rules: Sequence[Sequence[str]] = (), limit: int = 10) -> dict:
    """Write the findings over ``<tables>/*.parquet`` as of the date ``as_of`` (text that sorts by time) to ``<output>/as_of=...``.

    ``rules`` are pairs of path parts that must not depend on each other.  Findings of the date before that are
    gone are not carried on.  Empty tables give metrics of 0 alone.
    """
    output = output.rstrip("/")
    log.info("reading the tables of %s", tables)
    graph = load(spark, tables)
    history = read_or_empty(spark, output, FINDINGS)
    last = history.where(F.col("as_of") < as_of).agg(F.max("as_of").alias("as_of")).first().as_of
    before = history.where((F.col("as_of") == last) & (F.col("status") != "gone")) if last is not None else spark.createDataFrame([], FINDINGS)
    rows = Observation()
    out = compared(findings(graph, [tuple(r) for r in rules], limit), before)
    out = out.observe(rows, F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("new", "known", "gone")])
    out.withColumn("as_of", F.lit(as_of)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(output)
    done = {"as_of": as_of, "before": last, **rows.get}
    log.info("wrote %(n)d findings as of %(as_of)s: %(new)d new, %(known)d known, %(gone)d gone since %(before)s", done)
    return done


def report(spark: SparkSession, output: str) -> DataFrame:
    return read_or_empty(spark, output.rstrip("/"), FINDINGS)


if __name__ == "__main__":
    command(run, "health history")
