"""An immutable bundle of the graph's DataFrames, with set-based maintenance."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import ALLOWED, TABLES


@dataclass(frozen=True)
class CodeGraph:
    files: DataFrame
    functions: DataFrame
    classes: DataFrame
    variables: DataFrame
    edges: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> CodeGraph:
        return CodeGraph(**{n: spark.createDataFrame([], s) for n, s in TABLES.items()})

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLES}

    def labelled(self, label: str, src_type: str | None = None, dst_type: str | None = None) -> DataFrame:
        """Edges of one label (a partition of a stored graph) and, optionally, of given end types."""
        if label not in {a for a, _, _ in ALLOWED}:
            raise ValueError(f"unknown label {label!r}")
        e = self.edges.where(F.col("label") == label)
        for c, kind in (("src_type", src_type), ("dst_type", dst_type)):
            e = e.where(F.col(c) == kind) if kind else e
        return e

    def invalid_edges(self) -> DataFrame:
        """Edges whose label and end types are not in the schema."""
        ok = reduce(lambda a, b: a | b, ((F.col("label") == x) & (F.col("src_type") == y) & (F.col("dst_type") == z) for x, y, z in ALLOWED))
        return self.edges.where(~F.coalesce(ok, F.lit(False)))

    def ends(self) -> DataFrame:
        """(id, type) of every node."""
        parts = [self.files.select(F.col("path").alias("id"), F.lit("File").alias("type"))]
        parts += [t.select("id", F.lit(k).alias("type")) for t, k in ((self.functions, "Function"), (self.classes, "Class"), (self.variables, "Variable"))]
        return reduce(DataFrame.unionByName, parts)

    def insert(self, **rows: DataFrame) -> CodeGraph:
        """Append nodes (of equal keys the stored one stays) and edges whose ends both exist; edges are a bag."""
        new = {}
        for name in ("files", "functions", "classes", "variables"):
            if name in rows:
                key = "path" if name == "files" else "id"
                old, more = getattr(self, name), rows[name].select(*TABLES[name].names).dropDuplicates([key])
                new[name] = old.unionByName(more.join(old.select(key), key, "left_anti").select(*TABLES[name].names))
        out = CodeGraph(**(self.tables() | new))
        if "edges" in rows:
            ends, e = out.ends(), rows["edges"].select(*TABLES["edges"].names)
            for side in ("src", "dst"):
                e = e.join(ends.select(F.col("id").alias(side), F.col("type").alias(f"{side}_type")), [side, f"{side}_type"], "left_semi")
            out = CodeGraph(**out.tables() | {"edges": out.edges.unionByName(e.select(*TABLES["edges"].names))})
        return out

    def delete_files(self, paths: DataFrame) -> CodeGraph:
        """Without the files in ``paths`` (column path), their entities, and every edge that touches either."""
        paths = paths.select("path").distinct()
        kept = {"files": self.files.join(paths, "path", "left_anti")}
        gone = [paths.select(F.col("path").alias("id"), F.lit("File").alias("type"))]
        for name, kind in (("functions", "Function"), ("classes", "Class"), ("variables", "Variable")):
            t, by = getattr(self, name), paths.withColumnRenamed("path", "file_path")
            kept[name] = t.join(by, "file_path", "left_anti").select(*t.columns)
            gone.append(t.join(by, "file_path", "left_semi").select("id", F.lit(kind).alias("type")))
        gone = reduce(DataFrame.unionByName, gone)
        e = self.edges
        for side in ("src", "dst"):
            e = e.join(gone.select(F.col("id").alias(side), F.col("type").alias(f"{side}_type")), [side, f"{side}_type"], "left_anti")
        return CodeGraph(**kept, edges=e.select(*self.edges.columns))

    def is_empty(self) -> bool:
        return self.files.limit(1).isEmpty()

    def has_file(self, path: str) -> bool:
        return not self.files.where(F.col("path") == path).limit(1).isEmpty()
