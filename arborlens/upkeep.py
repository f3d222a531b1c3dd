"""A graph on disk that is kept current file by file.

Extracted rows, file rows and resolved edges are Parquet tables partitioned by a hash of the file they come
from.  An update reads and extracts only the changed files, works out which other files' edges may change with
them, resolves those again and overwrites the partitions that hold them, and no others.  The result equals a
full build from the same files.

Imports are kept as sources with whole folders and sources with single files; the pairs of files, which can be as
many as sources times files, are made when the graph is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import CodeGraph
from .plans.resolve import affected_sources, import_pairs, inherited, met_folders, references_by_file, sort_imports
from .schema import FILES
from .sources.extract import ROWS, entities
from .store import open_files

#: Each table's columns; the first one named is the file that a row belongs to.  An import leads to all files of ``dir`` or to ``dst``.
TABLES = {
    "files": ("path", "path string, hash string, last_modified long"),
    "rows": ("file_path", ROWS),
    "imports": ("src", "src string, dir string, dst string"),
    "heritage": ("file_path", "file_path string, src string, dst string"),
    "calls": ("file_path", "file_path string, src string, dst string"),
}
#: The rows that edges are resolved from.
KINDS = {"imports": "kind = 'import'", "heritage": "kind = 'implements'", "calls": "kind = 'function'"}


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of ``spark.sql``, with an underscore for each dot; they are put back."""
    held = {f"spark.sql.{k.replace('_', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def measured_broadcasts(spark: SparkSession):
    """Tables are broadcast by the size that a shuffle has measured, a megabyte at most, not by that of files, which hold
    paths and names in a small part of the bytes that they take in the driver's memory."""
    return settings(spark, adaptive_autoBroadcastJoinThreshold="1m", autoBroadcastJoinThreshold="-1")


class LiveGraph:
    """``<root>/<table>/bucket=...``; ``buckets`` belongs to the folder and stays as it was when it was begun.

    There is one writer.  An update writes edges before rows and file rows last, so one that was broken off is
    made good by doing the same update again.  Readers that must not see a graph between two states read a
    ``GraphStore`` instead.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self, column: str) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A stored table, or those partitions of it."""
        file, schema = TABLES[name]
        try:
            df = self._read(name, f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        if buckets is not None:
            df = df.where(F.col("bucket").isin(buckets))
        return df.where(F.col(file).isNotNull()).drop("bucket")

    def _read(self, name: str, path: str) -> DataFrame:
        """A table's rows with their partitions, those without a file too."""
        return self.spark.read.schema(f"{TABLES[name][1]}, bucket int").parquet(path)

    def _marked(self, name: str, df: DataFrame, buckets: list[int]) -> DataFrame:
        """A table's rows with their partitions, each of which gets one row without a file, so that one that has become empty is overwritten too."""
        file, schema = TABLES[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        marks = self.spark.createDataFrame([(b,) for b in buckets], "bucket int").select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")], "bucket")
        return df.select(*columns).withColumn("bucket", self._bucket(file)).unionByName(marks)

    def _write(self, name: str, df: DataFrame, buckets: list[int]) -> None:
        """Overwrite partitions; rows that come with their partitions lie together already and are not shuffled."""
        out = df if "bucket" in df.columns else self._marked(name, df, buckets).hint("rebalance", "bucket")
        self._put(out, f"{self.root}/{name}", "dynamic")

    def _put(self, df: DataFrame, path: str, mode: str) -> None:
        with open_files(self.spark, self.buckets + 1):
            df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(path)

    def _replace(self, name: str, gone: DataFrame, new: DataFrame, buckets: list[int], ahead: str | None = None) -> None:
        """Overwrite partitions with their rows of other files than ``gone`` (distinct file) and with ``new`` rows; or write them to ``ahead``.

        Rows are shuffled once, by partition and a share of it, which serves the join and the writer.  The join is an outer
        one, since the optimizer moves an anti join before the shuffle; both tables are read as they were written.
        """
        file = TABLES[name][0]
        shares = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        dealt = lambda df, column: df.withColumn("share", F.pmod(F.xxhash64(F.lit(1), column), F.lit(shares))).repartition("bucket", "share")
        rows = self._marked(name, self.table(name, buckets), []).withColumn("old", F.lit(True)).unionByName(self._marked(name, new, buckets).withColumn("old", F.lit(False)))
        rows, gone = dealt(rows, file).alias("l"), dealt(gone.select("file", self._bucket("file").alias("bucket"), F.lit(True).alias("gone")), "file").alias("r")
        same = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.share") == F.col("r.share")) & (F.col(f"l.{file}") == F.col("r.file")) & F.col("l.old")
        rows = rows.join(gone, same, "left").where("gone is null").select(*[F.col(f"l.{c.split()[0]}") for c in TABLES[name][1].split(", ")], "l.bucket")
        with settings(self.spark, requireAllClusterKeysForCoPartition="false"):
            if ahead:
                self._put(rows, ahead, "static")
            else:
                self._write(name, rows, buckets)

    def build(self, files: DataFrame, rows: DataFrame, refs: DataFrame | None = None) -> None:
        """Everything anew from files (path, hash, last_modified), their symbols and references (callee_id, ref_path, ref_line)."""
        every = list(range(self.buckets))
        with measured_broadcasts(self.spark):
            self._write("rows", rows, every)
            rows = self.table("rows")
            self._write("imports", self._imports(rows, files), every)
            self._write("heritage", self._heritage(rows, rows), every)
            self._write("calls", self._calls(rows, refs), every)
            self._write("files", files, every)

    def _imports(self, rows: DataFrame, files: DataFrame) -> DataFrame:
        i = sort_imports(rows.where("kind = 'import'").select(F.col("file_path").alias("source_path"), F.col("target").alias("path")), files)
        return met_folders(self._noted("sorted", i), files).withColumnRenamed("source_path", "src")

    @staticmethod
    def _heritage(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
        """Edges of the classes in ``rows``, to the classes of ``all_rows`` that they name."""
        named = rows.where("kind = 'implements'").select("file_path", F.col("parent_id").alias("from_class_id"), F.col("target").alias("to_class_name"))
        return inherited(named, all_rows.where("kind = 'class'")).select("file_path", F.col("from_class_id").alias("src"), "dst")

    def _calls(self, rows: DataFrame, refs: DataFrame | None) -> DataFrame:
        if refs is None:
            return self.spark.createDataFrame([], TABLES["calls"][1])
        return references_by_file(refs, rows.where("kind = 'function'").dropDuplicates(["id"])).withColumnRenamed("ref_path", "file_path")

    def update(self, changed: DataFrame, files: DataFrame, rows: DataFrame, refs: DataFrame | None = None) -> dict[str, list[int]]:
        """Bring the graph up to date after changes of the files ``changed`` (path); the partitions written, by table.

        ``files`` and ``rows`` are those of the changed files that are there now: one that has none is gone.

        Imports are resolved again where they are in a changed file, or may meet a file that came or went; a
        new text of a file that was there changes no other file's imports.  Inheritance is resolved again in
        changed files and where a class name is meant that a changed file had or has.  Calls are resolved again
        in changed files and in those that call, or called, a function of a changed file; ``refs`` are all
        references as they are now, and may differ from those before in these files alone.
        """
        with measured_broadcasts(self.spark):
            return self._update(changed, files, rows, refs)

    def _update(self, changed: DataFrame, files: DataFrame, rows: DataFrame, refs: DataFrame | None) -> dict[str, list[int]]:
        changed = self._noted("changed", changed.select("path").where("path is not null").distinct())
        touched = self._buckets_of(changed, "path")
        if not touched:
            return {}
        rows, files = self._noted("rows", rows.select(*[c.split()[0] for c in ROWS.split(", ")])), self._noted("files", files.select(*FILES.names))
        sources = changed.withColumnRenamed("path", "file")
        of_changed = lambda df, column, how: df.join(changed.withColumnRenamed("path", column), column, how).select(*df.columns)
        old_rows, new_rows = of_changed(self.table("rows", touched), "file_path", "left_semi"), rows
        others, ahead = [b for b in range(self.buckets) if b not in touched], {}
        for name, new in (("rows", new_rows), ("files", files)):  # what these tables are going to be, written last
            self._replace(name, sources, new, touched, f"{self.root}/update/next_{name}")
            ahead[name] = self._read(name, f"{self.root}/update/next_{name}")
        now, now_files = (self.table(name, others).unionByName(ahead[name].where(F.col(TABLES[name][0]).isNotNull()).drop("bucket")) for name in ("rows", "files"))

        before = of_changed(self.table("files", touched), "path", "left_semi").select("path")
        after = files.select("path").distinct()
        shifted = self._noted("shifted", before.subtract(after).unionByName(after.subtract(before)))
        imports = sources
        if not shifted.isEmpty():
            imports = imports.unionByName(affected_sources(now.where("kind = 'import'").select(F.col("file_path").alias("source_path"), F.col("target").alias("path")), shifted).toDF("file")).distinct()
        names = old_rows.unionByName(new_rows).where("kind = 'class'").select(F.col("name").alias("target")).distinct()
        heirs = sources.unionByName(now.where("kind = 'implements'").join(names, "target", "left_semi").select(F.col("file_path").alias("file"))).distinct()

        callers = sources
        if refs is not None:
            own = lambda df: df.where("kind = 'function'").select("id").distinct()
            callers = sources.unionByName(refs.join(own(new_rows).toDF("callee_id"), "callee_id", "left_semi").select(F.col("ref_path").alias("file")))
            callers = callers.unionByName(self.table("calls").join(own(old_rows).toDF("dst"), "dst", "left_semi").select(F.col("file_path").alias("file"))).where("file is not null").distinct()

        written = {}
        for name, affected, edges in (
            ("imports", imports, lambda part, _: self._imports(part, now_files)),
            ("heritage", heirs, lambda part, _: self._heritage(part, now)),
            ("calls", callers, lambda part, ref: self._calls(part, ref)),
        ):
            affected = self._noted(f"{name}_sources", affected)
            some = self._buckets_of(affected, "file")
            part = now.where(KINDS[name]).join(affected.withColumnRenamed("file", "file_path"), "file_path", "left_semi").select(*now.columns)
            own = None if refs is None else refs.join(affected.withColumnRenamed("file", "ref_path"), "ref_path", "left_semi").select(*refs.columns)
            self._replace(name, affected, self._noted(f"{name}_edges", edges(part, own)), some)
            written[name] = some
        for name in ("rows", "files"):
            self._write(name, ahead[name], touched)
        return written | {"rows": touched, "files": touched}

    def _noted(self, name: str, df: DataFrame) -> DataFrame:
        """What one update works with, written once; the next update overwrites it."""
        path = f"{self.root}/update/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _buckets_of(self, df: DataFrame, column: str) -> list[int]:
        """The partitions that some files are in: ``buckets`` numbers at most."""
        return sorted(r.b for r in df.select(self._bucket(column).alias("b")).distinct().collect())

    def graph(self) -> CodeGraph:
        rows, files = self.table("rows"), self.table("files")
        functions, classes, variables, edges = entities(rows)
        edge = lambda df, kind, label: df.select("src", F.lit(kind).alias("src_type"), "dst", F.lit(kind).alias("dst_type"), F.lit(label).alias("label"))
        imports = import_pairs(self.table("imports").withColumnRenamed("src", "source_path"), files)
        edges = reduce(DataFrame.unionByName, [edges, edge(imports, "File", "IMPORTS"), edge(self.table("heritage"), "Class", "IMPLEMENTS"), edge(self.table("calls"), "Function", "CALLS")])
        return CodeGraph(files, functions, classes, variables, edges)
