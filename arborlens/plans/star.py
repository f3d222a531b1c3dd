"""The test tables as a code graph: one SQL text for Spark and for DuckDB."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..schema import TABLES

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _sha(x: str, duck: bool) -> str:
    return f"sha256({x})" if duck else f"sha2({x}, 256)"


_PATHS = "SELECT s_suppkey, concat(r_name, '/', n_name, '/', s_name) AS path, s_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"
_COUNT = "(SELECT count(*) AS n, min(s_suppkey) AS low FROM {supplier})"


def node_sql(table: str, duck: bool) -> str:
    """``{n}`` and ``{low}``, the suppliers' count and least key, are numbers in Spark's text, so that no join is needed for them."""
    sha = lambda x: _sha(x, duck)
    file_of = lambda key: f"CROSS JOIN {_COUNT} c JOIN ({_PATHS}) p ON p.s_suppkey = {key} % c.n + c.low" if duck else f"JOIN ({_PATHS}) p ON p.s_suppkey = {key} % {{n}} + {{low}}"
    return {
        "files": f"SELECT path, {sha('s_name')} AS hash, CAST(s_suppkey AS BIGINT) AS last_modified FROM ({_PATHS})",
        "functions": f"SELECT concat('fn:', CAST(p_partkey AS STRING)) AS id, p_name AS name, path AS file_path, concat(p_type, ' ', p_brand) AS docstring, {sha("concat(p_type, '|', p_brand, '|', CAST(p_size AS STRING))")} AS ast_hash, CAST(p_partkey * 10 + 1 AS BIGINT) AS start_line, CAST(p_partkey * 10 + 9 AS BIGINT) AS end_line, p_size % 2 = 0 AS is_exported FROM {{part}} {file_of('p_partkey')}",
        "classes": f"SELECT concat('cl:', CAST(c_custkey AS STRING)) AS id, concat(c_mktsegment, '_', CAST(c_nationkey AS STRING)) AS name, path AS file_path, '' AS docstring, CASE c_nationkey % 3 WHEN 0 THEN 'interface' WHEN 1 THEN 'class' ELSE 'struct' END AS type_category, {sha('c_mktsegment')} AS ast_hash FROM {{customer}} {file_of('c_custkey')}",
        "variables": f"SELECT concat('va:', CAST(o_orderkey AS STRING)) AS id, concat('order_', CAST(o_orderkey AS STRING)) AS name, path AS file_path, o_orderpriority AS type_hint FROM {{orders}} {file_of('o_custkey')}",
    }[table]


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag"


def edge_sql(duck: bool) -> list[str]:
    """One query for each kind of edge."""
    e = lambda src, st, dst, dt, label, rest: f"SELECT {src} AS src, '{st}' AS src_type, {dst} AS dst, '{dt}' AS dst_type, '{label}' AS label {rest}"
    tag = lambda t, k: f"concat('{t}:', CAST({k} AS STRING))"
    pair = lambda col: f"(SELECT {col} AS b, lag({col}) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS a FROM {{lineitem}} WHERE l_returnflag = 'R')"
    out = [e("file_path", "File", "id", kind, "CONTAINS", f"FROM ({node_sql(t, duck)})") for t, kind in (("functions", "Function"), ("classes", "Class"), ("variables", "Variable"))]
    out.append(e(tag("cl", "o_custkey"), "Class", tag("va", "o_orderkey"), "Variable", "CONTAINS", "FROM {orders}"))
    out.append(e(tag("cl", "o_custkey"), "Class", tag("fn", "l_partkey"), "Function", "CONTAINS", "FROM (SELECT DISTINCT o_custkey, l_partkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber = 1)"))
    out.append(e(tag("fn", "a"), "Function", tag("fn", "b"), "Function", "CALLS", f"FROM {pair('l_partkey')} WHERE a <> b"))
    out.append(e("x.path", "File", "y.path", "File", "IMPORTS", f"FROM (SELECT DISTINCT a, b FROM {pair('l_suppkey')} WHERE a <> b) JOIN ({_PATHS}) x ON x.s_suppkey = a JOIN ({_PATHS}) y ON y.s_suppkey = b"))
    out.append(e(tag("cl", "c_custkey"), "Class", tag("cl", "CAST(floor(c_custkey / 2) AS BIGINT)"), "Class", "IMPLEMENTS", "FROM {customer} WHERE c_custkey > 1 AND floor(c_custkey / 2) >= (SELECT min(c_custkey) FROM {customer})"))
    return out


class StarGraph(CodeGraph):
    """The graph over ``<sf_dir>/<table>.parquet``.  Tables are planned when they are asked for, edges by label."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.__dict__.update(_spark=spark, _dir=sf_dir, _branches={}, _sources={}, _keys=None)

    def _run(self, text: str) -> DataFrame:
        marks = {t for t in SOURCES if "{" + t + "}" in text} | ({"supplier"} if "{n}" in text else set())
        for t in marks - self._sources.keys():
            self._sources[t] = self._spark.read.parquet(f"{self._dir}/{t}.parquet")
        if "{n}" in text:
            if self._keys is None:
                n, low = self._sources["supplier"].agg(F.count("*"), F.min("s_suppkey")).first()
                self.__dict__["_keys"] = {"{n}": str(max(n, 1)), "{low}": str(low or 0)}
            for mark, value in self._keys.items():
                text = text.replace(mark, value)
        if _PATHS in text:  # one row for each supplier, read by nearly every table: joined to nation and region once
            if "paths" not in self._sources:
                self._sources["paths"] = self._spark.sql(_PATHS, **{t: self._sources[t] for t in ("supplier", "nation", "region")}).persist()
            text = text.replace(f"({_PATHS})", "{paths}")
        return self._spark.sql(text, **{t: df for t, df in self._sources.items() if "{" + t + "}" in text})

    def _edges(self, *marks: str) -> DataFrame:
        """The kinds of edges whose query has all the marks: others are never planned."""
        texts = [q for q in edge_sql(False) if all(m in q for m in marks)]
        for q in texts:
            if q not in self._branches:
                self._branches[q] = self._run(q)
        return reduce(DataFrame.unionByName, [self._branches[q] for q in texts]) if texts else self._spark.sql(f"SELECT {', '.join(f'CAST(NULL AS STRING) AS {c}' for c in TABLES['edges'].names)} WHERE false")

    files = cached_property(lambda self: self._run(node_sql("files", False)))
    functions = cached_property(lambda self: self._run(node_sql("functions", False)))
    classes = cached_property(lambda self: self._run(node_sql("classes", False)))
    variables = cached_property(lambda self: self._run(node_sql("variables", False)))
    edges = cached_property(lambda self: self._edges())

    def labelled(self, label: str, src_type: str | None = None, dst_type: str | None = None) -> DataFrame:
        wanted = {"label": label, "src_type": src_type, "dst_type": dst_type}
        return self._edges(*[f"'{v}' AS {c}" for c, v in wanted.items() if v])


class Without(CodeGraph):
    """A graph whose edges to the nodes ``gone`` (dst), of one kind, are left out, by label as they are asked for."""

    def __init__(self, graph: CodeGraph, gone: DataFrame, kind: str, **tables: DataFrame):
        self.__dict__.update(graph=graph, gone=gone, kind=kind, files=graph.files, functions=graph.functions, classes=graph.classes, variables=graph.variables)
        self.__dict__.update(tables)

    def _kept(self, e: DataFrame) -> DataFrame:
        return e.join(self.gone, "dst", "left_anti").select(*TABLES["edges"].names)

    edges = cached_property(lambda self: self._kept(self.graph.edges))

    def labelled(self, label: str, src_type: str | None = None, dst_type: str | None = None) -> DataFrame:
        e = self.graph.labelled(label, src_type, dst_type)
        return self._kept(e) if dst_type in (None, self.kind) else e.select(*TABLES["edges"].names)


def load(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return StarGraph(spark, sf_dir)


def snapshots(graph: CodeGraph) -> tuple[CodeGraph, CodeGraph]:
    """(current, target) for differences: functions missing on either side, and some restructured."""
    key = "CAST(substring(id, 4) AS BIGINT)"
    cur = graph.functions.where(f"{key} % 11 <> 0")
    old = graph.functions.where(f"{key} % 10 <> 0").selectExpr("id", "name", "file_path", "docstring", f"CASE WHEN {key} % 7 = 0 THEN concat('x', ast_hash) ELSE ast_hash END AS ast_hash", "start_line", "end_line", "is_exported")
    unique = lambda f: f.selectExpr("id", "concat(name, '#', id) AS name", "file_path", "docstring", "ast_hash", "start_line", "end_line", "is_exported")
    both = []
    for f in (cur, old):
        gone = graph.functions.where(f"{key} % {11 if f is cur else 10} = 0").selectExpr("id AS dst")
        both.append(Without(graph, gone, "Function", functions=unique(f)))
    return both[0], both[1]


def duck_ctes() -> str:
    """The same graph as DuckDB common table expressions g_files ... g_edges."""
    names = {t: t for t in SOURCES}
    parts = [f"g_{t} AS ({node_sql(t, True).format(**names)})" for t in TABLES if t != "edges"]
    parts.append("g_edges AS (" + " UNION ALL ".join(q.format(**names) for q in edge_sql(True)) + ")")
    return "WITH " + ", ".join(parts)
