"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``<|start|>role<|message|>text<|end|>``.  Each assistant turn becomes one example: all turns
before it as context, then the turn itself, whose text alone is trainable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
TARGET_ROLE = "assistant"

#: What may not stand in a text as it is: the template's own marks and the control strings that chat models use.
#: An opening bracket, any number of backslashes, the rest; the rest holds no opening bracket, so none overlap.
_OPEN, _REST = r"([<\[])", r"(\|[A-Za-z0-9_]{1,32}\|>|/?s>|/?SYS>|/?INST\])"
CONTROL = _OPEN + r"(\\*)" + _REST
ESCAPED = _OPEN + r"\\(\\*)" + _REST


def escape(text: Column) -> Column:
    """Put a backslash into every control string, behind its bracket: ``</s>`` becomes ``<\\/s>``.

    One that has backslashes there gets one more, so that ``unescape`` gives back every text.
    """
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted, turns)``: each conversation in the template, and where its turns stand.

    ``turns`` is an array of (role, text_start, text_end, end), places in code points.  Rows go by turn, nulls
    first, ties by role, then text; repeated rows are turns of their own.  Null roles and texts are empty, the
    rows of a null id are one conversation.  The conversation is the unit of work: its text is one value.
    """
    said = df.select(column(conv_col).alias("conv_id"), column(turn_col).alias("turn"), *[F.coalesce(column(c), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    whole = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    parts = whole.select("conv_id", F.transform("said", lambda x: F.struct(x.role.alias("role"), escape(x.role).alias("head"), escape(x.text).alias("body"))).alias("said"))
    marks = len(START + MESSAGE), len(END)
    none = F.array().cast("array<struct<role:string,text_start:long,text_end:long,end:long>>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)).getField("end"), F.lit(0).cast("long"))

    def place(done: Column, x: Column) -> Column:
        start = last(done) + F.char_length(x.getField("head")) + marks[0]
        stop = start + F.char_length(x.getField("body"))
        return F.array_append(done, F.struct(x.role.alias("role"), start.alias("text_start"), stop.alias("text_end"), (stop + marks[1]).alias("end")))

    return parts.select(
        "conv_id",
        F.array_join(F.transform("said", lambda x: F.concat(F.lit(START), x.getField("head"), F.lit(MESSAGE), x.getField("body"), F.lit(END))), "").alias("formatted"),
        F.aggregate("said", none, place).alias("turns"),
    )


def examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, example, n_context, complete, text, loss_start, loss_end)``: one row for each assistant turn.

    ``text`` holds the ``n_context`` turns before it and the turn itself; code points ``loss_start`` to
    ``loss_end`` (exclusive), its reply, are trainable and nothing else is.  Where turns follow the last
    assistant turn, or there is none, one more row holds the whole conversation with nothing trainable, so
    that no turn is lost: each conversation has one ``complete`` row, its last.  Rows, ties and nulls as in
    ``conversations``; an empty table gives none.  The examples of a conversation are as long together as
    the method says, the square of its turns; they are cut from its one text as rows are read and are never
    shuffled or kept, so memory is bounded by the longest conversation.
    """
    c = conversations(df, conv_col, turn_col, role_col, text_col)
    n = F.size("turns")
    shown = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i).getField("role") == TARGET_ROLE) | (i == n))
    at = F.element_at("turns", F.col("upto"))
    trainable = at.getField("role") == TARGET_ROLE
    stop = lambda field: F.when(trainable, at.getField(field)).otherwise(at.getField("end"))
    return c.select("conv_id", "formatted", "turns", F.posexplode(shown).alias("example", "upto")).select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (F.col("upto") - F.when(trainable, 1).otherwise(0)).cast("long").alias("n_context"),
        (F.col("upto") == n).alias("complete"),
        F.substring("formatted", F.lit(1), at.getField("end").cast("int")).alias("text"),
        stop("text_start").alias("loss_start"),
        stop("text_end").alias("loss_end"),
    )


def turns_of(text: Column) -> Column:
    """An array of (role, text), unescaped: the turns of an example, read from its text alone."""
    quoted = lambda mark: "".join("\\" + x if x in "|" else x for x in mark)
    pieces = F.filter(F.split(text, quoted(END), -1), lambda x: x != "")
    role = lambda x: F.substring_index(F.substring(x, len(START) + 1, 1 << 30), MESSAGE, 1)
    return F.transform(pieces, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substring_index(x, MESSAGE, -1)).alias("text")))


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """What is trainable in an example, unescaped."""
    return unescape(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def digests(shown: DataFrame) -> DataFrame:
    """One row for each conversation, read back from ``examples``: its turns from the example that has them
    all, what is trainable from every one, and the code points of all examples."""
    loss = F.transform(F.sort_array(F.collect_list(F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("said")))), lambda x: x.said)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    lines = F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n")))
    seen = shown.withColumn("turns", F.when(F.col("complete"), turns_of(F.col("text"))))
    seen = seen.withColumn("n", F.when(F.col("complete"), F.size("turns").cast("long"))).withColumn("sha", F.when(F.col("complete"), sha(F.array_join(lines, ""))))
    out = seen.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.array_join(loss, "").alias("loss"), F.sum(F.char_length("text")).alias("formatted_chars"), F.count("*").alias("n_examples"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")


#: A conversation that tries the template's marks.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` (conv_id, turn, role, text) and conversation -1, a user and an assistant turn of control strings."""
    rows = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return df.select("conv_id", "turn", "role", "text").unionByName(rows)


#: DuckDB SQL for ``digests(examples(with_probe(conversations)))``: lengths of prefixes by a running sum.
SQL_DIGESTS = """
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{probe}' UNION ALL SELECT -1, 1, 'assistant', '{probe}'),
sized AS (
    SELECT *, {fixed} + length(regexp_replace(role, {control}, {with}, 'g')) + length(regexp_replace(text, {control}, {with}, 'g')) AS n,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS of
    FROM said),
placed AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto, role = 'assistant' AS target FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (target), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (target), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (target OR k = of) AS BIGINT) AS formatted_chars, count(*) FILTER (target OR k = of) AS n_examples
FROM placed GROUP BY conv_id
""".format(probe=PROBE, fixed=len(START + MESSAGE + END), control="'" + CONTROL + "'", **{"with": r"'\1\\\2\3'"})
