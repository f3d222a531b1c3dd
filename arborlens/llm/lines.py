"""Line deduplication by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh

RATIO, MIN_PAGES = 0.05, 5


def _lines(text):
    return F.split(text, "\n", -1)


def _key(line):
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate_lines(df: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, line_key)`` of the lines on more than ``ratio`` of a host's pages and on ``min_pages`` at least.

    Pages of one host with equal text count once, in the numerator and in the total, so copies of a page do
    not turn its lines into boilerplate.  A host can have at most mean-lines-per-page / ratio such lines.
    """
    pages = df.select(column(host_col).alias("host"), F.unhex(F.md5(column(text_col).cast("binary"))).alias("page"), _lines(column(text_col)).alias("lines")).where(F.col("page").isNotNull())
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    seen = (
        pages.select("host", "page", F.explode(F.array_distinct(F.transform("lines", lambda x: F.trim(x)))).alias("line"))
        .where("line <> ''")
        .select("host", _key(F.col("line")).alias("line_key"), "page")
        .distinct()
        .groupBy("host", "line_key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    return seen.alias("s").join(totals.alias("t"), F.col("s.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > F.col("total") * F.lit(ratio)).select("s.host", "line_key")


def drop_boilerplate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text_col`` and two columns ``_n_lines``, ``_n_dropped``.

    Lines end at line feeds and compare without surrounding spaces; blank lines are never boilerplate and
    stay.  Null text stays null (0 lines); a null host is a host of its own; repeated rows and repeated ids
    are all kept; an empty table stays empty.  Other columns pass through; where ``df`` has a column of a
    result's name, that result gets another underscore.  Only keys of lines are shuffled to find what to drop.
    """
    bad = boilerplate_lines(df, text_col, host_col, ratio, min_pages)
    hit_id, hit_host, keys, left, n_lines, n_dropped = fresh(df, "hit_id", "hit_host", "hit_keys", "kept", "_n_lines", "_n_dropped")
    lines = df.select(column(host_col).alias("host"), column(id_col).alias("id"), F.explode(F.array_distinct(F.transform(_lines(column(text_col)), lambda x: F.trim(x)))).alias("line")).where("line <> ''").select("host", "id", _key(F.col("line")).alias("line_key"))
    hits = (
        lines.alias("l")
        .join(bad.alias("b"), F.col("l.host").eqNullSafe(F.col("b.host")) & (F.col("l.line_key") == F.col("b.line_key")))
        .groupBy(F.col("l.id").alias(hit_id), F.col("l.host").alias(hit_host))
        .agg(F.collect_set("l.line_key").alias(keys))
    )
    joined = df.join(hits, column(id_col).eqNullSafe(F.col(hit_id)) & column(host_col).eqNullSafe(F.col(hit_host)), "left")
    text = column(text_col)
    all_lines = _lines(text)
    kept = F.when(F.col(keys).isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(keys), _key(x))))
    return (
        joined.withColumn(left, kept)
        .select(
            *[F.when(F.col(keys).isNull(), text).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else column(c) for c in df.columns],
            F.when(text.isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias(n_lines),
            F.when(text.isNull(), 0).otherwise(F.size(all_lines) - F.size(left)).cast("long").alias(n_dropped),
        )
    )


#: DuckDB SQL for ``drop_boilerplate`` over a relation with doc_id, text and source; {docs} names it.
SQL_KEPT = """
_pages AS (SELECT DISTINCT source, text FROM {docs} WHERE text IS NOT NULL),
_totals AS (SELECT source, count(*) AS total FROM _pages GROUP BY source),
_seen AS (SELECT source, line, count(*) AS n FROM (
    SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')))) AS line FROM _pages)
    WHERE line <> '' GROUP BY source, line HAVING count(*) >= {min_pages}),
_bad AS (SELECT _seen.source, list(line) AS lines FROM _seen JOIN _totals ON _seen.source IS NOT DISTINCT FROM _totals.source
    WHERE n > total * CAST({ratio} AS DOUBLE) GROUP BY _seen.source),
_kept AS (SELECT d.*, string_split(d.text, chr(10)) AS all_lines,
    list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') = '' OR _bad.lines IS NULL OR NOT list_contains(_bad.lines, trim(x, ' '))) AS kept_lines
    FROM {docs} d LEFT JOIN _bad ON d.source IS NOT DISTINCT FROM _bad.source)
"""
