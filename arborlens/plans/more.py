"""More registered queries: import resolution, displayed matches, whole differences, columns of paths, extraction and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, extension, join_path, language, name_position
from ..graph import CodeGraph
from ..operators import diff, lookup
from ..schema import EXTENSIONS
from ..sources.extract import symbols
from ..store import GraphStore
from . import resolve
from .catalogue import _CLONES, _DEAD, _METRICS, _VIOLATIONS, ORACLES, RULES, _cyclic, query
from .shared import new_folder
from .star import Without, load

# ---- imports ----------------------------------------------------------------------------------------------------------

# One text for both engines: a file for each supplier, some at the root, and imports of each form.
_FILES = "SELECT concat('d', CAST(s_nationkey % 5 AS STRING), '/n', CAST(s_nationkey AS STRING), '/m', CAST(s_suppkey AS STRING), CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN '.go' WHEN 1 THEN '.py' ELSE '.tsx' END) AS path FROM {supplier} UNION ALL SELECT concat('d', CAST(s_nationkey % 5 AS STRING), '/n', CAST(s_nationkey AS STRING), '/m', CAST(s_suppkey AS STRING), '.js') FROM {supplier} WHERE s_suppkey % 3 = 2 UNION ALL SELECT concat('u', CAST(n_nationkey AS STRING), '.py') FROM {nation}"
_IMPORTS = """SELECT concat('d', CAST(s_nationkey % 5 AS STRING), '/n', CAST(s_nationkey AS STRING), '/m', CAST(s_suppkey AS STRING), CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN '.go' WHEN 1 THEN '.py' ELSE '.tsx' END) AS source_path,
CASE CAST(k AS INT) WHEN 0 THEN concat('./m', CAST(s_suppkey + 1 AS STRING)) WHEN 1 THEN concat('../n', CAST((s_suppkey * 7) % 25 AS STRING)) WHEN 2 THEN concat('pkg.d', CAST(s_suppkey % 6 AS STRING), '.n', CAST(s_nationkey AS STRING), '.Thing')
    WHEN 3 THEN concat('lib/u', CAST(s_suppkey % 40 AS STRING)) WHEN 4 THEN concat('.././n', CAST(s_nationkey AS STRING), '/m', CAST(s_suppkey AS STRING)) ELSE '..' END AS path FROM {supplier}, (SELECT explode_k AS k FROM {ks})"""


def _named(text: str, ks: str) -> str:
    return text.format(supplier="supplier", nation="nation", ks=ks)


# By nested loops over all files, and paths resolved by a rule for these imports alone.
@query(f"""WITH f AS (SELECT path AS dst, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_replace(path, '^.*/|\\.[a-z]*$', '', 'g') AS stem FROM ({_named(_FILES, '')})),
i AS (SELECT DISTINCT source_path, path, regexp_replace(source_path, '/[^/]*$', '') AS here FROM ({_named(_IMPORTS, '(SELECT unnest(range(0, 6)) AS explode_k)')})),
b AS (SELECT *, CASE WHEN path LIKE './%' THEN here || substr(path, 2) WHEN path LIKE '.././%' THEN regexp_replace(here, '/[^/]*$', '') || substr(path, 5) WHEN path LIKE '../%' THEN regexp_replace(here, '/[^/]*$', '') || substr(path, 3) WHEN path = '..' THEN regexp_replace(here, '/[^/]*$', '') END AS base FROM i),
exact AS (SELECT source_path, path, arg_min(dst, r) AS dst FROM b JOIN (VALUES {", ".join(f"({k}, '{e}')" for k, e in enumerate(EXTENSIONS))}) x(r, ext) ON TRUE JOIN f ON dst = base || ext GROUP BY ALL),
rest AS (SELECT * FROM b WHERE (source_path, path) NOT IN (SELECT (source_path, path) FROM exact)),
folder AS (SELECT * FROM rest WHERE base IS NOT NULL AND EXISTS (SELECT 1 FROM f WHERE starts_with(dst, base || '/'))),
loose AS (SELECT *, list_filter(string_split_regex(path, '[./]'), lambda x: x <> '') AS segs FROM rest WHERE (source_path, path) NOT IN (SELECT (source_path, path) FROM folder))
SELECT DISTINCT source_path AS src, dst FROM (SELECT source_path, dst FROM exact UNION ALL SELECT source_path, dst FROM folder JOIN f ON starts_with(dst, base)
UNION ALL SELECT source_path, dst FROM loose JOIN f ON len(segs) > 0 AND CASE WHEN dir <> '' THEN contains(array_to_string(segs, '/'), dir) ELSE segs[-1] = stem END) WHERE source_path <> dst""")
def import_resolution_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation")}
    ks = spark.range(6).select(F.col("id").alias("explode_k"))
    return resolve.resolve_imports(spark.sql(_IMPORTS, supplier=tables["supplier"], ks=ks), spark.sql(_FILES, **tables))


# ---- differences and displayed nodes -----------------------------------------------------------------------------------


def _sides(g: CodeGraph) -> tuple[CodeGraph, CodeGraph]:
    """Files, classes and variables that come, go and change."""
    n = "CAST(substring(id, 4) AS BIGINT)"
    nobody = g.files.where("false").selectExpr("path AS dst")
    unique = lambda t, keep: t.where(f"{n} % {keep} <> 0").withColumn("name", F.concat("name", F.lit("#"), "id"))
    a = Without(g, nobody, "File", functions=g.functions.where("false"), files=g.files.where("last_modified % 13 <> 0"), classes=unique(g.classes, 11), variables=unique(g.variables, 17))
    b = Without(g, nobody, "File", functions=g.functions.where("false"), files=g.files.where("last_modified % 7 <> 0").withColumn("hash", F.expr("CASE WHEN last_modified % 5 = 0 THEN 'new' ELSE hash END")), classes=unique(g.classes, 19).withColumn("ast_hash", F.expr(f"CASE WHEN {n} % 4 = 0 THEN concat(ast_hash, 'x') ELSE ast_hash END")), variables=unique(g.variables, 23))
    return a, b


def _all_sides() -> str:
    n = "CAST(substring(id, 4) AS BIGINT)"
    kinds = (
        ("File", "SELECT path AS sid, split_part(path, '/', -1) AS name, path AS file_path, {hash} AS content FROM g_files WHERE last_modified % {f} <> 0", {"a": {"f": 13, "hash": "hash"}, "b": {"f": 7, "hash": "CASE WHEN last_modified % 5 = 0 THEN 'new' ELSE hash END"}}),
        ("Class", f"SELECT concat(file_path, '::', name, '#', id) AS sid, concat(name, '#', id) AS name, file_path, {{hash}} AS content FROM g_classes WHERE {n} % {{f}} <> 0", {"a": {"f": 11, "hash": "ast_hash"}, "b": {"f": 19, "hash": f"CASE WHEN {n} % 4 = 0 THEN concat(ast_hash, 'x') ELSE ast_hash END"}}),
        ("Variable", f"SELECT concat_ws('::', file_path, owner, concat(v.name, '#', id)) AS sid, concat(v.name, '#', id) AS name, file_path, '' AS content FROM g_variables v LEFT JOIN (SELECT dst AS oid, arg_max(concat(c.name, '#', c.id), src) AS owner FROM g_edges JOIN g_classes c ON c.id = src WHERE label = 'CONTAINS' AND src_type = 'Class' AND dst_type = 'Variable' AND CAST(substring(c.id, 4) AS BIGINT) % {{c}} <> 0 GROUP BY dst) ON oid = id WHERE {n} % {{f}} <> 0", {"a": {"f": 17, "c": 11}, "b": {"f": 23, "c": 19}}),
    )
    parts = [f"SELECT CASE WHEN b.sid IS NULL THEN 'added' WHEN a.sid IS NULL THEN 'deleted' WHEN a.content <> b.content THEN 'modified' END AS change, coalesce(a.sid, b.sid) AS id, '{kind}' AS type, coalesce(a.name, b.name) AS name, coalesce(a.file_path, b.file_path) AS file_path FROM ({text.format(**v['a'])}) a FULL JOIN ({text.format(**v['b'])}) b ON a.sid = b.sid" for kind, text, v in kinds]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE change IS NOT NULL"


@query(_all_sides())
def graph_diff_other_nodes(g: CodeGraph) -> DataFrame:
    return diff.diff_nodes(*_sides(g))


@query("""SELECT n.*, coalesce(o.id, f.id) AS display_id FROM (SELECT CASE WHEN last_modified % 2 = 0 THEN path ELSE concat('gone/', path) END AS id, 'File' AS type, split_part(path, '/', -1) AS name FROM g_files UNION ALL SELECT concat(file_path, '::', name), 'Class', name FROM g_classes) n
LEFT JOIN (SELECT path AS id FROM g_files UNION ALL SELECT id FROM g_functions UNION ALL SELECT id FROM g_classes UNION ALL SELECT id FROM g_variables) o ON o.id = n.id
LEFT JOIN (SELECT 'File' AS type, split_part(path, '/', -1) AS name, min(path) AS id FROM g_files GROUP BY ALL UNION ALL SELECT 'Class', name, min(id) FROM g_classes GROUP BY ALL) f ON f.type = n.type AND f.name = n.name""")
def displayed_match(g: CodeGraph) -> DataFrame:
    nodes = g.files.select(F.when(F.col("last_modified") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("gone/"), "path")).alias("id"), F.lit("File").alias("type"), base_name(F.col("path")).alias("name"))
    nodes = nodes.unionByName(g.classes.select(F.concat("file_path", F.lit("::"), "name").alias("id"), F.lit("Class").alias("type"), "name"))
    return diff.match_displayed(nodes, lookup.export_nodes(g).select("label", "id", "group"))


# ---- columns of paths --------------------------------------------------------------------------------------------------

_EXT = "CASE CAST(page_id % 9 AS INT) " + " ".join(f"WHEN {k} THEN '{e.upper() if k == 2 else e}'" for k, e in enumerate(EXTENSIONS)) + " WHEN 7 THEN '.rs' ELSE '' END"


@query(f"""SELECT page_id, concat('a/b', {_EXT}) AS path, lower({_EXT}) AS ext, CASE lower({_EXT}) WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.java' THEN 'java' ELSE 'plaintext' END AS language,
CAST(greatest(strpos(url, 'en') - 1, 0) AS INT) AS at, concat('x/', CAST(page_id % 7 AS VARCHAR), '/y') AS joined FROM pages""")
def path_columns_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr(f"concat('a/b', {_EXT})").alias("path"))
    joined = join_path(F.lit("x/z"), F.concat(F.lit(".././"), (F.col("page_id") % 7).cast("string"), F.lit("//q/../y")))
    return p.select("page_id", "path", extension(F.col("path")).alias("ext"), language(F.col("path"), "plaintext").alias("language"), name_position(F.col("url"), F.lit("en")).cast("int").alias("at"), joined.alias("joined"))


# ---- extraction ---------------------------------------------------------------------------------------------------------

def _literal(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


#: Parts as functions of generated source files, twenty to a file, in five languages by turns.
_PARTS = "SELECT *, row_number() OVER (PARTITION BY q ORDER BY k) AS r, CAST(q % 5 AS INT) AS lang FROM (SELECT p_partkey AS k, CAST(floor(p_partkey / 20) AS BIGINT) AS q, coalesce(p_type, '') AS about, CAST(coalesce(p_size, 0) AS STRING) AS size FROM {part})"
_SOURCE_FILES = """SELECT concat('s', CAST(q % 7 AS STRING), '/f', CAST(q AS STRING), element_at(array('.go', '.py', '.java', '.ts', '.js'), lang + 1)) AS path,
concat(CASE lang WHEN 0 THEN 'package p\n\n' WHEN 2 THEN concat('public class C', CAST(q AS STRING), ' {{\n') ELSE '' END, array_join(transform(sort_array(collect_list(struct(r, said))), x -> x.said), ''), CASE lang WHEN 2 THEN '}}\n' ELSE '' END) AS text FROM (SELECT *, CASE lang
WHEN 0 THEN concat('// ', about, '\nfunc Fn', CAST(k AS STRING), '(a int) int {{\n\treturn a + ', size, '\n}}\n\n')
WHEN 1 THEN concat('# ', about, '\ndef fn_', CAST(k AS STRING), '(a):\n    return a + ', size, '\n\n')
WHEN 2 THEN concat('  public int fn', CAST(k AS STRING), '(int a) {{\n    return a + ', size, ';\n  }}\n')
WHEN 3 THEN concat('export function fn', CAST(k AS STRING), '(a: number) {{\n  return a + ', size, ';\n}}\n\n')
ELSE concat('function fn', CAST(k AS STRING), '(a) {{\n  return a + ', size, ';\n}}\n\n') END AS said FROM {parts}) GROUP BY q, lang"""


@query(f"""WITH p AS (SELECT *, concat('s', CAST(q % 7 AS STRING), '/f', CAST(q AS STRING), ['.go', '.py', '.java', '.ts', '.js'][lang + 1]) AS file_path FROM ({_PARTS.format(part='part')}))
SELECT 'function' AS kind, concat(['Fn', 'fn_', 'fn', 'fn', 'fn'][lang + 1], CAST(k AS STRING)) AS name, file_path, CAST(CASE lang WHEN 0 THEN 5 * r - 1 WHEN 1 THEN 4 * r - 2 WHEN 2 THEN 3 * r - 1 ELSE 4 * r - 3 END AS BIGINT) AS start_line,
CAST(CASE lang WHEN 0 THEN 5 * r + 1 WHEN 1 THEN 4 * r - 1 WHEN 2 THEN 3 * r + 1 ELSE 4 * r - 1 END AS BIGINT) AS end_line, CASE lang WHEN 2 THEN 'Class' ELSE 'File' END AS parent_type,
CASE lang WHEN 0 THEN about WHEN 1 THEN concat('# ', about) ELSE '' END AS docstring, TRUE AS is_exported, count(*) OVER (PARTITION BY lang) AS alike FROM p
UNION ALL SELECT DISTINCT 'class', concat('C', CAST(q AS STRING)), file_path, 1, NULL, 'File', '', NULL, NULL FROM p WHERE lang = 2""")
def extract_symbols_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of source files that Spark makes from parts; ``alike`` counts the functions of one shape in a language."""
    parts = spark.sql(_PARTS, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    files = spark.sql(_SOURCE_FILES, parts=parts).select("path", F.col("text").cast("binary").alias("content"))
    rows = symbols(files).withColumn("language", F.element_at(F.split("file_path", "[.]"), -1))
    shapes = rows.where("kind = 'function'").groupBy("language", "ast_hash").agg(F.count("*").alias("n"))
    return rows.join(shapes, ["language", "ast_hash"], "left").select("kind", "name", "file_path", "start_line", "end_line", "parent_type", "docstring", "is_exported", F.when(F.col("kind") == "function", F.col("n")).alias("alike"))


# ---- the report -----------------------------------------------------------------------------------------------------------


def _report_sql() -> str:
    cell = lambda c: f"replace(replace(replace({c}, '\\', '\\\\'), '|', '\\|'), chr(10), ' ')"
    line = lambda *c: " || ' | ' || ".join(c)
    nl = "chr(10)"

    def table(head: str, columns: int, rows: str, order: str, none: str, lead: str = "") -> str:
        body = f"(SELECT string_agg('| ' || row || ' |', {nl} ORDER BY {order}) FROM ({rows}))"
        top = f"{_literal(lead)} || {nl} || {nl} || " if lead else ""
        return f"coalesce({top}{_literal('| ' + head + ' |')} || {nl} || {_literal('|' + ' --- |' * columns)} || {nl} || {body}, {_literal(none)})"

    cyclic = _cyclic()
    ctes, cyclic = cyclic[: cyclic.rindex(" SELECT DISTINCT s AS")], cyclic[cyclic.rindex(" SELECT DISTINCT s AS") :]
    god = f"SELECT n, name, file_path, {line(cell('name'), cell('file_path'), 'CAST(n AS VARCHAR)')} AS row FROM (SELECT name, file_path, count(*) AS n FROM g_edges JOIN g_classes ON src = id WHERE label = 'CONTAINS' AND src_type = 'Class' GROUP BY ALL ORDER BY n DESC, name, file_path LIMIT 10)"
    hole = god.replace("g_classes ON src = id WHERE label = 'CONTAINS' AND src_type = 'Class'", "g_functions ON dst = id WHERE label = 'CALLS'")
    cycle = f"SELECT file_path, {cell('file_path')} AS row FROM ({cyclic} ORDER BY 1 LIMIT 5)"
    dead = f"SELECT file_path, function_name, {line(cell('function_name'), cell('file_path'))} AS row FROM ({_DEAD})"
    raw = _METRICS.replace("round(cloned / functions, 6)", "cloned / functions").replace("round(dead / functions, 6)", "dead / functions").replace("round(interfaces / concrete, 6)", "interfaces / concrete")
    status = f"SELECT k, metric || ' | ' || shown || ' | ' || least || ' | ' || CASE WHEN bad THEN 'Danger' ELSE 'Pass' END AS row FROM ({raw}) m, LATERAL (VALUES (1, 'SCR', printf('%.2f%%', 100 * m.SCR), '10.00%', m.SCR > 0.1), (2, 'DCR', printf('%.2f%%', 100 * m.DCR), '5.00%', m.DCR > 0.05), (3, 'BVI', CAST(m.BVI AS VARCHAR), '0', m.BVI > 0), (4, 'AOI', printf('%.2f%%', 100 * m.AOI), '50.00%', m.AOI > 0.5)) t(k, metric, shown, least, bad)"
    assert _CLONES in raw and _VIOLATIONS in raw and RULES
    parts = [
        f"'# Code health report' || {nl} || {nl} || 'Made: -' || {nl} || 'Workspace: workspace'",
        f"'## 1. Largest classes' || {nl} || {nl} || " + table("Class | File | Contains", 3, god, "n DESC, name, file_path", "No class contains anything."),
        f"'## 2. Most called functions' || {nl} || {nl} || " + table("Function | File | Call sites", 3, hole, "n DESC, name, file_path", "No function is called."),
        f"'## 3. Import cycles' || {nl} || {nl} || " + table("File", 1, cycle, "file_path", "No import cycle.", "Files that import themselves over others:"),
        f"'## 4. Unused private functions' || {nl} || {nl} || " + table("Function | File", 2, dead, "file_path, function_name", "Every private function is used."),
        f"'## 5. Metrics' || {nl} || {nl} || " + table("Metric | Value | Threshold | Status", 4, status, "k", "No metric."),
    ]
    return f"{ctes} SELECT " + f" || {nl} || {nl} || ".join(parts) + f" || {nl} AS report"


@query(_report_sql())
def markdown_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .report import markdown

    return spark.createDataFrame([(markdown(load(spark, sf_dir), "workspace", RULES, at="-"),)], "report string")


# ---- stored graphs, stable nodes, ordered imports ---------------------------------------------------------------------------


@query("SELECT src, src_type, dst, dst_type, label FROM g_edges UNION ALL SELECT path, 'File', hash, 'Hash', 'STORED' FROM g_files")
def stored_graph_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph saved as a version, then opened for reading only: its edges, and its files with their hashes."""
    root = new_folder(spark, "store")
    writer = GraphStore(spark, root)
    if not writer.load().is_empty():
        raise AssertionError("a new store has a graph")
    g = load(spark, sf_dir)
    writer.save(CodeGraph(g.files, g.functions, g.classes, g.variables, g.edges))
    stored = GraphStore(spark, root, read_only=True).load()
    files = stored.files.select(F.col("path").alias("src"), F.lit("File").alias("src_type"), F.col("hash").alias("dst"), F.lit("Hash").alias("dst_type"), F.lit("STORED").alias("label"))
    return stored.edges.unionByName(files)


_OWNERS = "SELECT dst AS oid, arg_max(c.name, src) AS owner FROM g_edges JOIN g_classes c ON c.id = src WHERE label = 'CONTAINS' AND src_type = 'Class' AND dst_type = '{kind}' GROUP BY dst"


@query(f"""SELECT path AS id, path AS sid, 'File' AS type, split_part(path, '/', -1) AS name, path AS file_path, hash AS content FROM g_files
UNION ALL SELECT f.id, concat_ws('::', file_path, owner, name), 'Function', name, file_path, ast_hash FROM g_functions f LEFT JOIN ({_OWNERS.format(kind='Function')}) ON oid = f.id
UNION ALL SELECT id, concat_ws('::', file_path, name), 'Class', name, file_path, ast_hash FROM g_classes
UNION ALL SELECT v.id, concat_ws('::', file_path, owner, name), 'Variable', name, file_path, NULL FROM g_variables v LEFT JOIN ({_OWNERS.format(kind='Variable')}) ON oid = v.id""")
def stable_nodes(g: CodeGraph) -> DataFrame:
    """Every node with the id that does not depend on its place in its file."""
    return diff.stable_nodes(g)


def import_resolution_ordered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that lead to a file before their own, by path components."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation")}
    ks = spark.range(6).select(F.col("id").alias("explode_k"))
    return resolve.resolve_imports(spark.sql(_IMPORTS, supplier=tables["supplier"], ks=ks), spark.sql(_FILES, **tables), ordered=True)


query(f"SELECT * FROM ({ORACLES['import_resolution']}) WHERE string_split(src, '/') > string_split(dst, '/')")(import_resolution_ordered_tables)
