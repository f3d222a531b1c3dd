"""Versioned Parquet snapshots of a graph behind a pointer, on any file system that Spark reaches."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .graph import CodeGraph
from .schema import ALLOWED, TABLES


@contextmanager
def open_files(spark: SparkSession, n: int) -> Iterator[None]:
    """A task keeps a file open for each of up to ``n`` partitions that it writes, where it would sort all its rows by partition
    first, in memory that grows with them; the setting is put back."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class GraphStore:
    """``<root>/v-<id>/<table>`` and ``<root>/CURRENT``, which names the version readers see.

    Readers never block: a version is never changed after the pointer names it.  Edges are partitioned by
    label, so queries of one label read one directory.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        pointer = self._path(f"{self.root}/CURRENT")
        for left in (4, 3, 2, 1, 0):
            try:
                if not self._fs.exists(pointer):
                    return None
                stream = self._fs.open(pointer)
                try:
                    return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
                finally:
                    stream.close()
            except Py4JJavaError:  # replaced while it was read: local file systems swap a file and its checksum one after the other
                if not left:
                    raise
                time.sleep(0.2)

    def load(self) -> CodeGraph:
        v = self.version()
        if v is None:
            return CodeGraph.empty(self.spark)
        return CodeGraph(**{n: self.spark.read.schema(s).parquet(f"{self.root}/{v}/{n}") for n, s in TABLES.items()})

    def symbols(self) -> DataFrame | None:
        """The extracted rows that the current version was resolved from, if they were kept."""
        v = self.version()
        if v is None or not self._fs.exists(self._path(f"{self.root}/{v}/symbols")):
            return None
        return self.spark.read.parquet(f"{self.root}/{v}/symbols")

    def stage(self, symbols: DataFrame) -> tuple[str, DataFrame]:
        """Write the rows of a version to come; (version, the rows as written)."""
        if self.read_only:
            raise PermissionError("the store was opened read-only")
        v = f"v-{uuid.uuid4().hex}"
        symbols.write.parquet(f"{self.root}/{v}/symbols")
        return v, self.spark.read.schema(symbols.schema).parquet(f"{self.root}/{v}/symbols")

    def save(self, graph: CodeGraph, version: str | None = None) -> str:
        if self.read_only:
            raise PermissionError("the store was opened read-only")
        v = version or f"v-{uuid.uuid4().hex}"
        with open_files(self.spark, len({label for label, _, _ in ALLOWED}) + 1):
            for name, df in graph.tables().items():
                writer = df.select(*TABLES[name].names).write
                (writer.partitionBy("label") if name == "edges" else writer).parquet(f"{self.root}/{v}/{name}")
        stream = self._fs.create(self._path(f"{self.root}/CURRENT.new"), True)
        stream.write(bytearray(v.encode()))
        stream.close()
        # One atomic step: readers see the old version or the new one.
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        rename = getattr(fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(self._path(f"{self.root}/CURRENT.new"), self._path(f"{self.root}/CURRENT"), how)
        return v

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all versions but the current one and the ``keep`` latest before it, which readers may still use; their names."""
        if self.read_only:
            raise PermissionError("the store was opened read-only")
        now, root = self.version(), self._path(self.root)
        there = sorted((s.getModificationTime(), s.getPath().getName()) for s in self._fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("v-")) if self._fs.exists(root) else []
        old = [name for _, name in there if name != now]
        gone = old[: max(0, len(old) - keep)]
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return gone

    def reset(self) -> None:
        """Forget everything (a forced rebuild)."""
        if self.read_only:
            raise PermissionError("the store was opened read-only")
        self._fs.delete(self._path(self.root), True)
