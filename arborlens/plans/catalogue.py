"""Registered queries over the star-schema tables and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_dir, uri_to_path
from ..graph import CodeGraph
from ..operators import diff, health, lookup, walks
from ..sources.ignore import DEFAULTS, glob_regex, ignored
from ..streaming.live import debounce_batch
from . import resolve
from .star import duck_ctes, load, snapshots

RULES = [("ASIA", "EUROPE"), ("CHINA", ""), ("a", "z")]
TARGET, FILE_KEY = "blue anvil", 3
QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Register a function of (graph) or, with ``_tables`` in its name, of (spark, sf_dir)."""

    def add(f):
        name = f.__name__.removesuffix("_tables")
        QUERIES[name] = f if f.__name__.endswith("_tables") else lambda spark, sf_dir: f(load(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = (duck_ctes() + " " if "g_" in oracle and not oracle.lstrip().startswith("WITH") else "") + oracle
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most-called functions beside the graph's health metrics."""
    g = load(spark, sf_dir)
    return health.black_holes(g).crossJoin(_metrics(g))


_SEARCH = """SELECT 'Function' AS type, name, file_path, start_line FROM g_functions WHERE contains(name, '{t}') OR contains(docstring, '{t}')
UNION ALL SELECT 'Class', name, file_path, NULL FROM g_classes WHERE contains(name, '{t}') OR contains(docstring, '{t}')
UNION ALL SELECT 'Variable', name, file_path, NULL FROM g_variables WHERE contains(name, '{t}')"""


@query(_SEARCH.format(t="ring"))
def search_functions(g: CodeGraph) -> DataFrame:
    return lookup.search(g, "ring").drop("block")


@query(_SEARCH.format(t=""))
def search_all(g: CodeGraph) -> DataFrame:
    return lookup.search(g, "").drop("block")


def _hops(depth: int) -> str:
    steps = [f"w1 AS (SELECT src AS node, dst AS tgt, CAST(count(*) AS HUGEINT) AS n FROM g_edges JOIN g_functions ON dst = id WHERE label = 'CALLS' AND name = '{TARGET}' GROUP BY ALL)"]
    steps += [f"w{k} AS (SELECT src AS node, tgt, CAST(sum(n) AS HUGEINT) AS n FROM w{k - 1} JOIN g_edges ON dst = node WHERE label = 'CALLS' GROUP BY ALL)" for k in range(2, depth + 1)]
    union = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(1, depth + 1))
    return f"{duck_ctes()}, {', '.join(steps)} SELECT a.name AS caller_name, a.file_path AS caller_file, b.name AS callee_name, b.file_path AS callee_file, CAST(sum(n) AS BIGINT) AS walks FROM ({union}) w JOIN g_functions a ON a.id = node JOIN g_functions b ON b.id = tgt GROUP BY ALL"


@query(_hops(1))
def call_chain_d1(g: CodeGraph) -> DataFrame:
    return walks.call_chain(g, TARGET, 1)


@query(_hops(3))
def call_chain_d3(g: CodeGraph) -> DataFrame:
    return walks.call_chain(g, TARGET, 3)


@query(_hops(5))
def call_chain_d5_counts(g: CodeGraph) -> DataFrame:
    return walks.call_chain(g, TARGET, 9)


@query(_hops(3).replace("CAST(sum(n) AS BIGINT) AS walks", "1 AS one").replace("SELECT a.name", "SELECT caller_name, caller_file, callee_name, callee_file FROM (SELECT a.name", 1) + ")")
def call_chain_distinct(g: CodeGraph) -> DataFrame:
    return walks.call_chain(g, TARGET, 3, "distinct")


def _cyclic() -> str:
    steps = ["i AS (SELECT DISTINCT src, dst FROM g_edges WHERE label = 'IMPORTS')", "c1 AS (SELECT src AS s, dst AS n FROM i)"]
    steps += [f"c{k} AS (SELECT DISTINCT s, dst AS n FROM c{k - 1} JOIN i ON n = src)" for k in range(2, 6)]
    return f"{duck_ctes()}, {', '.join(steps)} SELECT DISTINCT s AS file_path FROM ({' UNION ALL '.join(f'SELECT * FROM c{k}' for k in range(1, 6))}) WHERE s = n"


@query(_cyclic())
def import_cycles(g: CodeGraph) -> DataFrame:
    return walks.cyclic_files(g)


@query(_cyclic() + " ORDER BY file_path LIMIT 5")
def import_cycles_top(g: CodeGraph) -> DataFrame:
    return walks.cycles(g)


@query("SELECT name AS class_name, file_path, count(*) AS n FROM g_edges JOIN g_classes ON src = id WHERE label = 'CONTAINS' AND src_type = 'Class' GROUP BY ALL ORDER BY n DESC, class_name, file_path LIMIT 10")
def god_objects(g: CodeGraph) -> DataFrame:
    return health.god_objects(g)


@query("SELECT name AS function_name, file_path, count(*) AS n FROM g_edges JOIN g_functions ON dst = id WHERE label = 'CALLS' GROUP BY ALL ORDER BY n DESC, function_name, file_path LIMIT 10")
def black_holes(g: CodeGraph) -> DataFrame:
    return health.black_holes(g)


_DEAD = "SELECT name AS function_name, file_path FROM g_functions WHERE NOT is_exported AND id NOT IN (SELECT dst FROM g_edges WHERE label = 'CALLS')"


@query(_DEAD)
def dead_code(g: CodeGraph) -> DataFrame:
    return health.dead_code(g)


_CLONES = "SELECT ast_hash, name, file_path, start_line FROM (SELECT *, count(*) OVER (PARTITION BY ast_hash) AS k FROM g_functions WHERE ast_hash <> '') WHERE k > 1"


@query(_CLONES)
def clone_members(g: CodeGraph) -> DataFrame:
    return health.clone_members(g)


@query(f"SELECT ast_hash, count(*) AS members, min(file_path) AS first_file FROM ({_CLONES}) GROUP BY ast_hash")
def clone_groups(g: CodeGraph) -> DataFrame:
    return health.clone_groups(g).select("ast_hash", F.size("functions").cast("long").alias("members"), F.col("functions")[0]["file_path"].alias("first_file"))


@query("SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS members, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_exact_clones_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_doc")).where("members > 1")


_RULES = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in RULES) + ") r(a, b)"
_VIOLATIONS = f"""SELECT v.*, concat(a, ' -> ', b) AS rule_violated FROM (
SELECT 'CALL' AS type, x.file_path AS from_path, x.name AS from_symbol, y.file_path AS to_path, y.name AS to_symbol FROM g_edges JOIN g_functions x ON x.id = src JOIN g_functions y ON y.id = dst WHERE label = 'CALLS'
UNION ALL SELECT 'IMPORT', src, NULL, dst, NULL FROM g_edges WHERE label = 'IMPORTS') v, {_RULES} WHERE contains(from_path, a) AND contains(to_path, b)"""


@query(_VIOLATIONS)
def boundary_violations(g: CodeGraph) -> DataFrame:
    return health.boundary_violations(g, RULES)


_STATS = "SELECT (SELECT count(*) FROM g_functions) AS functions, count(*) AS classes, count(*) FILTER (type_category = 'interface') AS interfaces, count(*) FILTER (type_category IN ('class', 'struct')) AS concrete FROM g_classes"


@query(_STATS)
def stats(g: CodeGraph) -> DataFrame:
    return health.stats(g)


_METRICS = f"""SELECT functions, classes, interfaces, concrete, cloned, dead, BVI, round(cloned / functions, 6) AS SCR, round(dead / functions, 6) AS DCR, round(interfaces / concrete, 6) AS AOI
FROM ({_STATS}), (SELECT count(*) AS cloned FROM ({_CLONES})), (SELECT count(*) AS dead FROM ({_DEAD})), (SELECT count(*) AS BVI FROM ({_VIOLATIONS}))"""


def _metrics(g: CodeGraph) -> DataFrame:
    return health.ai_metrics(g, RULES).withColumns({c: F.round(c, 6) for c in ("SCR", "DCR", "AOI")})


@query(_METRICS)
def ai_metrics(g: CodeGraph) -> DataFrame:
    return _metrics(g)


@query(f"SELECT metric, value, threshold, CASE WHEN value > threshold THEN 'Danger' ELSE 'Pass' END AS status FROM ({_METRICS}) m, LATERAL (VALUES ('SCR', m.SCR, 0.1::DOUBLE), ('DCR', m.DCR, 0.05), ('BVI', m.BVI::DOUBLE, 0), ('AOI', m.AOI, 0.5)) t(metric, value, threshold)")
def metric_status(g: CodeGraph) -> DataFrame:
    return health.metric_status(_metrics(g))


def _a_file(g: CodeGraph) -> str:
    return g.files.where(F.col("last_modified") == FILE_KEY).first().path


_AT = f"(SELECT path FROM g_files WHERE last_modified = {FILE_KEY})"
_OWNED = f"SELECT dst, c.name AS class_name FROM g_edges JOIN g_classes c ON c.id = src WHERE label = 'CONTAINS' AND src_type = 'Class' AND c.file_path = {_AT}"


@query(f"""SELECT 1 AS block, 'Function' AS type, name, NULL AS class_name, start_line, end_line FROM g_functions WHERE file_path = {_AT}
UNION ALL SELECT 2, 'Class', name, NULL, NULL, NULL FROM g_classes WHERE file_path = {_AT}
UNION ALL SELECT 3, 'Variable', name, NULL, NULL, NULL FROM g_variables WHERE file_path = {_AT}
UNION ALL SELECT 4, 'Method', name, class_name, start_line, end_line FROM ({_OWNED}) JOIN g_functions ON id = dst
UNION ALL SELECT 5, 'Field', name, class_name, NULL, NULL FROM ({_OWNED}) JOIN g_variables ON id = dst""")
def file_structure(g: CodeGraph) -> DataFrame:
    return lookup.file_structure(g, _a_file(g))


@query("SELECT file_path, start_line, end_line FROM g_functions WHERE id = 'fn:17'")
def function_range(g: CodeGraph) -> DataFrame:
    return lookup.function_range(g, "fn:17")


@query("""SELECT path AS id, split_part(path, '/', -1) AS label, 'File' AS "group", concat('File: ', path) AS title FROM g_files
UNION ALL SELECT id, name, 'Function', concat('Function: ', name, CASE WHEN docstring <> '' THEN concat(chr(10), docstring) ELSE '' END) FROM g_functions
UNION ALL SELECT id, name, 'Class', concat('Class: ', name, CASE WHEN docstring <> '' THEN concat(chr(10), docstring) ELSE '' END) FROM g_classes
UNION ALL SELECT id, name, 'Variable', concat('Variable: ', name, ' (', type_hint, ')') FROM g_variables""")
def export_nodes(g: CodeGraph) -> DataFrame:
    return lookup.export_nodes(g)


@query('SELECT src AS "from", dst AS "to", label FROM g_edges')
def export_edges(g: CodeGraph) -> DataFrame:
    return lookup.export_edges(g)


_KEY = "CAST(substring(id, 4) AS BIGINT)"
_A = f"SELECT concat(name, '#', id) AS name, file_path, ast_hash, id FROM g_functions WHERE {_KEY} % 11 <> 0"
_B = f"SELECT concat(name, '#', id) AS name, file_path, CASE WHEN {_KEY} % 7 = 0 THEN concat('x', ast_hash) ELSE ast_hash END AS ast_hash, id FROM g_functions WHERE {_KEY} % 10 <> 0"
_OWNER = "SELECT dst AS oid, arg_max(c.name, src) AS owner FROM g_edges JOIN g_classes c ON c.id = src WHERE label = 'CONTAINS' AND src_type = 'Class' AND dst_type = 'Function' GROUP BY dst"
_SID = "concat_ws('::', f.file_path, owner, f.name)"


@query(f"""SELECT change, coalesce(a.sid, b.sid) AS id, 'Function' AS type, coalesce(a.name, b.name) AS name, coalesce(a.file_path, b.file_path) AS file_path FROM
(SELECT {_SID} AS sid, f.* FROM ({_A}) f LEFT JOIN ({_OWNER}) ON oid = f.id) a FULL JOIN (SELECT {_SID} AS sid, f.* FROM ({_B}) f LEFT JOIN ({_OWNER}) ON oid = f.id) b ON a.sid = b.sid,
LATERAL (SELECT CASE WHEN b.sid IS NULL THEN 'added' WHEN a.sid IS NULL THEN 'deleted' WHEN a.ast_hash <> b.ast_hash THEN 'modified' END AS change) WHERE change IS NOT NULL""")
def graph_diff_nodes(g: CodeGraph) -> DataFrame:
    return diff.diff_nodes(*snapshots(g))


def _edge_diff() -> str:
    sides = {}
    for s, t in (("a", _A), ("b", _B)):
        nodes = f"SELECT f.id, {_SID} AS sid FROM ({t}) f LEFT JOIN ({_OWNER}) ON oid = f.id UNION ALL SELECT path, path FROM g_files UNION ALL SELECT id, concat_ws('::', file_path, name) FROM g_classes UNION ALL SELECT v.id, concat_ws('::', v.file_path, o.owner, v.name) FROM g_variables v LEFT JOIN (SELECT dst AS oid, arg_max(c.name, src) AS owner FROM g_edges JOIN g_classes c ON c.id = src WHERE label = 'CONTAINS' AND dst_type = 'Variable' AND src_type = 'Class' GROUP BY dst) o ON o.oid = v.id"
        sides[s] = f"{s}n AS ({nodes}), {s}e AS (SELECT DISTINCT x.sid AS f, y.sid AS t, label FROM g_edges JOIN {s}n x ON x.id = src JOIN {s}n y ON y.id = dst WHERE label <> 'CALLS')"
    return f"""{duck_ctes()}, {sides['a']}, {sides['b']} SELECT 'added' AS change, f AS "from", t AS "to", label AS type FROM (SELECT * FROM ae EXCEPT SELECT * FROM be) UNION ALL SELECT 'deleted', f, t, label FROM (SELECT * FROM be EXCEPT SELECT * FROM ae)"""


@query(_edge_diff())
def graph_diff_edges(g: CodeGraph) -> DataFrame:
    return diff.diff_edges(*snapshots(g))


_GONE = "SELECT path FROM g_files WHERE last_modified % 5 = 0"
_LOST = f"SELECT path AS id FROM ({_GONE}) UNION ALL SELECT id FROM g_functions WHERE file_path IN ({_GONE}) UNION ALL SELECT id FROM g_classes WHERE file_path IN ({_GONE}) UNION ALL SELECT id FROM g_variables WHERE file_path IN ({_GONE})"


@query(f"SELECT src, dst, label FROM g_edges WHERE src NOT IN ({_LOST}) AND dst NOT IN ({_LOST})")
def delta_delete(g: CodeGraph) -> DataFrame:
    return g.delete_files(g.files.where("last_modified % 5 = 0").select("path")).edges.select("src", "dst", "label")


@query("SELECT src, dst, label FROM g_edges")
def delta_upsert(g: CodeGraph) -> DataFrame:
    """Files go and come back: the graph is what a full build gives."""
    gone = g.files.where("last_modified % 5 = 0")
    left = g.delete_files(gone.select("path"))
    by = gone.select(F.col("path").alias("file_path"))
    again = {n: getattr(g, n).join(by, "file_path", "left_semi").select(*getattr(g, n).columns) for n in ("functions", "classes", "variables")}
    lost = gone.select(F.col("path").alias("id")).unionAll(again["functions"].select("id")).unionAll(again["classes"].select("id")).unionAll(again["variables"].select("id")).withColumn("lost", F.lit(True))
    e = g.edges.join(lost.toDF("src", "ls"), "src", "left").join(lost.toDF("dst", "ld"), "dst", "left").where("ls or ld").select(*g.edges.columns)
    return left.insert(files=gone, edges=e, **again).edges.select("src", "dst", "label")


@query("""SELECT src, callee AS dst FROM (SELECT concat('fn:', CAST(l_suppkey AS STRING)) AS callee, min(f.id) AS src FROM (SELECT *, row_number() OVER () AS k FROM lineitem) l JOIN g_functions r ON r.id = concat('fn:', CAST(l_partkey AS STRING)) JOIN g_functions f ON f.file_path = r.file_path AND r.start_line + l_linenumber BETWEEN f.start_line AND f.end_line GROUP BY k, callee) WHERE src <> callee""")
def file_functions_at_line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    fn = load(spark, sf_dir).functions
    where = fn.select(F.col("id").alias("rid"), F.col("file_path").alias("ref_path"), "start_line")
    refs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("fn:"), F.col("l_partkey").cast("string")).alias("rid"), F.concat(F.lit("fn:"), F.col("l_suppkey").cast("string")).alias("callee_id"), "l_linenumber")
    refs = refs.join(where, "rid").select("callee_id", "ref_path", (F.col("start_line") + F.col("l_linenumber")).alias("ref_line"))
    return resolve.resolve_references(refs, fn.withColumn("ord", F.col("id")))


@query("SELECT i.src, i.dst FROM (SELECT a.id AS src, (SELECT arg_min(b.id, [b.file_path, b.id]) FROM g_classes b WHERE b.name = c.name) AS dst FROM g_classes a JOIN g_edges e ON e.src = a.id JOIN g_classes c ON c.id = e.dst WHERE e.label = 'IMPLEMENTS') i WHERE i.src <> i.dst")
def class_heritage(g: CodeGraph) -> DataFrame:
    pairs = g.labelled("IMPLEMENTS").join(g.classes.select(F.col("id").alias("dst"), F.col("name").alias("to_class_name")), "dst").select(F.col("src").alias("from_class_id"), "to_class_name")
    return resolve.resolve_inheritance(pairs, g.classes)


_URLS = "(SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/|[?#].*$', '', 'g') AS path FROM pages)"
_GLOBS = [glob_regex(p) for p in (*DEFAULTS, "*e") if "*" in p]
_TEST = " OR ".join([f"list_has_any(string_split(path, '/'), {[*DEFAULTS, '*e', 'en']})", *(f"regexp_matches(path, '{r}') OR len(list_filter(string_split(path, '/'), lambda s: regexp_matches(s, '{r}'))) > 0" for r in _GLOBS)])


@query(f"SELECT page_id, path, {_TEST} AS ignored FROM {_URLS}")
def ignore_filter_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace("url", r"^[a-z]+://[^/]*/|[?#].*$", "").alias("path"))
    return p.withColumn("ignored", ignored(F.col("path"), [*DEFAULTS, "*e", "en"]))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def import_links_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT page_id, concat('/', regexp_replace(url, '^[a-z]+://[^/]*/', '')) AS path, regexp_replace(concat('/', regexp_replace(url, '^[a-z]+://[^/]*/', '')), '/?[^/]*$', '') AS folder FROM pages")
def uri_paths_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.regexp_replace("url", "^[a-z]+://[^/]*/", "file:///")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", uri_to_path(uri).alias("path"))
    return p.withColumn("folder", base_dir(F.col("path")))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS lines, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def line_slice_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return d.select("doc_id", lookup.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("lines"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("""SELECT CAST(user_id AS STRING) AS path, max(epoch_us(ts)) AS last_us, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM
(SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k""")
def debounce_sessions_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    return debounce_batch(e, 1800).select("path", F.unix_micros("last_ts").alias("last_us"), "n")


from . import more, upkeep  # noqa: E402, F401  (they register their queries)
