"""Shared plumbing of the operators: the shared folder, written tables, null-safe helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where it is unset, a temporary folder is chosen and set if all tasks
    run on this machine (a local master, as in tests); on a cluster that is an error, since executors would
    write to disks of their own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            path = "file://" + tempfile.mkdtemp(prefix="arborlens-")
            sc.setCheckpointDir(path)
    return path.rstrip("/")


_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/arborlens-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def remove_written(spark: SparkSession) -> None:
    """Delete what this driver has written to the shared folder; results that still read it must be saved first."""
    jvm = spark.sparkContext._jvm
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(task: Callable[[Iterator], Iterator], collect: bool = True) -> Callable[[Iterator], Iterator]:
    """``task`` over a partition's batches, and then what it has freed goes back to the system.

    A Python worker serves many tasks, and without this it keeps the most that any of them has held.  ``collect``
    also looks for objects that hold each other, which takes time where a large cache outlives the task.
    """

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        if collect:
            gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # the C library has it on Linux
            ctypes.CDLL(None).malloc_trim(0)

    return run


def spread(df: DataFrame, *keys) -> DataFrame:
    """``repartition`` by keys to the session's number of shuffle partitions.

    The number is explicit, so adaptive execution leaves the tasks as they are: work in Python on small
    rows would otherwise be merged into few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str):
    """Column names that ``df`` does not have in any letter case: the given ones, with underscores before them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out[0] if len(out) == 1 else out


def column(name: str) -> F.Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(col) -> F.Column:
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(col, F.lit("")).cast("binary")
