"""What the jobs share: their command line, their log, reading what may not be there yet."""

from __future__ import annotations

import argparse
import inspect
import json
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("arborlens.jobs")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command(job: Callable[..., dict], name: str, argv: list[str] | None = None) -> dict:
    """``CONFIG.json [--option value ...]``: run a job with the file's options, those of the command line before them.

    Options are the job's parameters; values of the command line are JSON, or text where they are none.
    """
    options = [p for p in inspect.signature(job).parameters if p != "spark"]
    parser = argparse.ArgumentParser(description=inspect.getdoc(job))
    parser.add_argument("config", help="JSON file of options")
    for o in options:
        parser.add_argument(f"--{o}")
    given = vars(parser.parse_args(argv))
    with open(given.pop("config"), encoding="utf-8") as f:
        config = json.load(f)
    if unknown := sorted(set(config) - set(options)):
        parser.error(f"unknown options in the config file: {', '.join(unknown)}")
    for o, text in given.items():
        if text is not None:
            try:
                config[o] = json.loads(text)
            except ValueError:
                config[o] = text
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        return job(spark, **config)
    finally:
        spark.stop()
