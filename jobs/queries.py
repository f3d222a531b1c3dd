"""The jobs as registered queries: each runs its job twice over the whole tables into one new folder and reads the output back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlens.plans import catalogue
from arborlens.plans.shared import new_folder

from . import copied_passages, health_history

AS_OF = "2026-01-05"


def job1_copied_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of three lines that stand more than once in the documents of a source."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        copied_passages.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return copied_passages.report(spark, f"{folder}/out")


def job2_health_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the code graph as of one date, all of them new."""
    folder = new_folder(spark, "job2")
    for _ in range(2):
        health_history.run(spark, sf_dir, f"{folder}/out", AS_OF, catalogue.RULES)
    return health_history.report(spark, f"{folder}/out")


QUERIES = {f.__name__: f for f in (job1_copied_passages, job2_health_history)}


def _findings() -> str:
    """The findings as one text, from the twins of the operators."""
    parts = {
        "god object": ("class_name, file_path, NULL, n", catalogue.ORACLES["god_objects"]),
        "black hole": ("function_name, file_path, NULL, n", catalogue.ORACLES["black_holes"]),
        "uncalled function": ("function_name, file_path, NULL, count(*)", catalogue.ORACLES["dead_code"]),
        "clone group": ("ast_hash, first_file, NULL, members", catalogue.ORACLES["clone_groups"]),
        "boundary violation": ("rule_violated, from_path, to_path, count(*)", catalogue.ORACLES["boundary_violations"]),
        "import cycle": ("file_path, file_path, NULL, 1", catalogue.ORACLES["import_cycles"]),
        "metric": ("metric, NULL, status, value", catalogue.ORACLES["metric_status"]),
    }
    each = [f"SELECT '{name}' AS finding, {cols} FROM ({sql}) {'GROUP BY ALL' if 'count' in cols else ''}" for name, (cols, sql) in parts.items()]
    return f"SELECT finding, subject, file_path, detail, CAST(value AS DOUBLE) AS value, 'new' AS status, '{AS_OF}' AS as_of FROM ({' UNION ALL '.join(each)}) t(finding, subject, file_path, detail, value)"


ORACLES = {"job1_copied_passages": copied_passages.SQL_REPORT, "job2_health_history": _findings()}
