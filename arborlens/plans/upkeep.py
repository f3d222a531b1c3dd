"""Registered queries of scans and of keeping a graph up to date."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search_index import build_index, search_indexed
from ..sources.extract import ROWS
from ..sources.tree import register
from ..streaming.bursts import bursts, keyed_state
from ..streaming.files import one_or_many
from ..upkeep import LiveGraph
from .catalogue import _SEARCH, query
from .shared import new_folder, written
from .star import load

# ---- a pruned scan --------------------------------------------------------------------------------------------------------

IGNORED = ["lang=fr", "tld=org/lang=de", "tld=net/lang=?s"]


@query(r"""SELECT page_id, concat('tld=', tld, '/lang=', lang) AS folder, sha256(coalesce(html, '')) AS hash FROM (SELECT page_id, html,
coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*\.([a-z]+)', 1), ''), 'none') AS tld, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1), ''), 'none') AS lang FROM pages)
WHERE lang <> 'fr' AND NOT (tld = 'org' AND lang = 'de') AND NOT (tld = 'net' AND length(lang) = 2 AND right(lang, 1) = 's')""")
def tree_scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages laid out as a tree of files by domain and language, and what a pruned scan of it reads."""
    part = lambda regex: F.coalesce(F.nullif(F.regexp_extract("url", regex, 1), F.lit("")), F.lit("none"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", part(r"^[a-z]+://[^/?#]*\.([a-z]+)").alias("tld"), part("^[a-z]+://[^/]*/([a-z]+)/").alias("lang"))
    root = new_folder(spark, "tree")
    pages.write.option("maxRecordsPerFile", 500).partitionBy("tld", "lang").json(root)
    register(spark)
    files = spark.read.format("sourcetree").options(root=root, patterns=json.dumps(IGNORED), extensions='[".json"]').load()
    lines = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    page = F.from_json("line", "page_id long, html string")
    return lines.select(page.alias("p"), "folder").select("p.page_id", "folder", F.sha2(F.coalesce("p.html", F.lit("")).cast("binary"), 256).alias("hash"))


# ---- a graph that is kept current -----------------------------------------------------------------------------------------

#: Events as versions of files: what a version's file imports, declares, extends and calls.
_VERSIONS = """SELECT concat('m', CAST(user_id % 7 AS STRING), '/u', CAST(user_id AS STRING), '/f', CAST(event_id % 40 AS STRING), CASE WHEN user_id % 2 = 0 THEN '.py' ELSE '.go' END) AS path,
event_id, event_type <> 'error' AS there, CASE WHEN event_id % 4 = 0 THEN concat('./f', CAST((event_id + 1) % 40 AS STRING)) WHEN event_id % 4 = 1 THEN concat('../u', CAST(user_id + 7 AS STRING))
WHEN event_id % 4 = 2 THEN concat('pkg.m', CAST((user_id + 1) % 7 AS STRING), '.u', CAST(user_id + 1 AS STRING), '.T') ELSE concat('../../m', CAST(event_id % 7 AS STRING), '/u', CAST(event_id % 150 AS STRING), '/f', CAST(event_id % 40 AS STRING)) END AS target,
concat('K', CAST(event_id % 700 AS STRING)) AS class_name, concat('K', CAST(event_id % 613 AS STRING)) AS parent_name, event_id % 25 AS line FROM {events}"""


def _rows(versions: DataFrame) -> DataFrame:
    """Rows as an extractor gives them: an import, a class that extends another and a function of 20 lines."""
    there = versions.where("there")
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ROWS.split(", ")}
    row = lambda **x: F.struct(*[x[c].alias(c) if c in x else v for c, v in none.items()])
    path, cl, fn = F.col("path"), F.concat("path", F.lit(":c")), F.concat("path", F.lit(":f"))
    file = {"file_path": path, "parent_id": path, "parent_type": F.lit("File")}
    kinds = F.array(
        row(kind=F.lit("import"), target=F.col("target"), file_path=path),
        row(kind=F.lit("class"), id=cl, name=F.col("class_name"), **file),
        row(kind=F.lit("implements"), parent_id=cl, target=F.col("parent_name"), file_path=path),
        row(kind=F.lit("function"), id=fn, name=F.lit("f"), start_line=F.lit(1).cast("long"), end_line=F.lit(20).cast("long"), ord=F.lit(0).cast("long"), **file),
    )
    return there.select(F.inline(kinds))


def _latest(events: DataFrame) -> DataFrame:
    """The last version of each file, written once.  A path stands for a user and a remainder, and what else a version has
    follows from its event, so numbers alone are aggregated and written."""
    e = events.groupBy("user_id", (F.col("event_id") % 40).alias("slot")).agg(F.max("event_id").alias("event_id"), F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("kept"))
    e = e.select("event_id", "user_id", F.when(F.col("event_id") == F.col("kept"), "kept").otherwise("error").alias("event_type"))
    return e.sparkSession.sql(_VERSIONS, events=written(e, "latest"))


_LAST = f"""v AS ({_VERSIONS.format(events='events')}), f AS (SELECT * FROM v WHERE event_id IN (SELECT max(event_id) FROM v GROUP BY path) AND there),
d AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM f),
i AS (SELECT path AS src, target, CASE WHEN target LIKE './%' THEN regexp_replace(path, '/[^/]*$', '') || substr(target, 2) WHEN target LIKE '../../%' THEN substr(target, 7) WHEN target LIKE '../%' THEN split_part(path, '/', 1) || substr(target, 3) END AS base FROM f),
exact AS (SELECT src, coalesce(g.path, p.path) AS dst FROM i LEFT JOIN f g ON g.path = base || '.go' LEFT JOIN f p ON p.path = base || '.py' WHERE coalesce(g.path, p.path) IS NOT NULL),
folder AS (SELECT src, base FROM i WHERE src NOT IN (SELECT src FROM exact) AND base IN (SELECT dir FROM d UNION ALL SELECT split_part(dir, '/', 1) FROM d)),
loose AS (SELECT src, array_to_string(list_filter(string_split_regex(target, '[./]'), lambda x: x <> ''), '/') AS joined FROM i WHERE src NOT IN (SELECT src FROM exact) AND src NOT IN (SELECT src FROM folder)),
k AS (SELECT class_name, min(path) AS path FROM f GROUP BY class_name)"""


@query(f"""WITH {_LAST} SELECT src, dst, 'IMPORTS' AS label FROM (SELECT * FROM exact UNION ALL SELECT src, path FROM folder JOIN d ON starts_with(path, base) UNION ALL SELECT src, path FROM loose JOIN (SELECT DISTINCT dir FROM d) x ON contains(joined, x.dir) JOIN d USING (dir)) WHERE src <> dst
UNION ALL SELECT f.path || ':c', k.path || ':c', 'IMPLEMENTS' FROM f JOIN k ON k.class_name = f.parent_name WHERE f.path <> k.path
UNION ALL SELECT path, path || ':c', 'CONTAINS' FROM f UNION ALL SELECT path, path || ':f', 'CONTAINS' FROM f
UNION ALL SELECT a.path || ':f', b.path || ':f', 'CALLS' FROM f a JOIN f b ON b.path = regexp_replace(a.path, '/u[0-9]*/', concat('/u', CAST(CAST(regexp_extract(a.path, '/u([0-9]*)/', 1) AS BIGINT) + 14 AS VARCHAR), '/')) WHERE a.line BETWEEN 1 AND 20""")
def incremental_graph_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of files: a graph of the first ones, brought up to date twice; its edges are those of the last versions."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    last = events.agg(F.max("event_id")).first()[0] or 0
    files = lambda v: v.where("there").select("path", F.col("event_id").cast("string").alias("hash"), F.col("event_id").alias("last_modified"))
    live = LiveGraph(spark, new_folder(spark, "live"), 32)
    for k, upto in enumerate((last * 17 // 20, last * 19 // 20, last)):
        now = _latest(events.where(F.col("event_id") <= upto)).where("there")
        callee = F.concat(F.regexp_extract("path", "^(.*/u)", 1), (F.regexp_extract("path", "/u([0-9]*)/", 1).cast("long") + 14).cast("string"), F.regexp_extract("path", "/u[0-9]*(/.*)$", 1))
        refs = now.select(callee.alias("callee"), F.col("path").alias("ref_path"), F.col("line").alias("ref_line")).join(now.select(F.col("path").alias("callee")), "callee", "left_semi")
        refs = written(refs.select(F.concat("callee", F.lit(":f")).alias("callee_id"), "ref_path", "ref_line"), "refs")
        if k == 0:
            live.build(files(now), _rows(now), refs)
        else:
            new = _latest(events.where((F.col("event_id") <= upto) & (F.col("event_id") > before)))
            live.update(new.select("path"), files(new), _rows(new), refs)
        before = upto
    return live.graph().edges.select("src", "dst", "label")


# ---- bursts from keyed state ----------------------------------------------------------------------------------------------


@query("""SELECT CAST(user_id AS STRING) AS path, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, arg_max(event_type, [epoch_us(ts)]) AS last_event, CAST(count(*) AS BIGINT) AS n FROM
(SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 10800000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k""")
def debounce_stream_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: each burst of a user's events once, when a timer of three hours has run out."""
    folder, path = new_folder(spark, "bursts"), f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    shown = lambda df: df.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    later = shown(table).agg(F.max("ts").alias("ts")).select(F.lit(None).cast("string").alias("path"), F.lit("").alias("event"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    later.write.parquet(f"{folder}/clock")  # moves time on, so that the last bursts come out
    events = shown(spark.readStream.schema(table.schema).parquet(one_or_many(path)))
    events = events.unionByName(spark.readStream.schema(later.schema).parquet(f"{folder}/clock"))
    with keyed_state(spark):
        q = bursts(events, 10_800_000).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# ---- search by an index ---------------------------------------------------------------------------------------------------

NEEDLES = ["ring", "blue anvil", "BUILDING_1", "r#", "_12", "zzz"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS needle, * FROM ({_SEARCH.format(t=t)})" for t in NEEDLES))
def search_indexed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several texts looked for by the trigram index of a snapshot."""
    path = new_folder(spark, "search")
    build_index(load(spark, sf_dir), path)
    return reduce(DataFrame.unionByName, [search_indexed(spark, path, t).drop("block").withColumn("needle", F.lit(t)) for t in NEEDLES])
