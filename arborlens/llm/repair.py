"""Repair of conversation structure: the cheapest edits that make the roles of each conversation alternate.

A row is kept (K, 0), given the role user or assistant (R, 1) or deleted (D, 2; blank and repeated rows must
be), and empty turns can be put anywhere (I, 5); a truncated row that stays costs 5 more.  The roles must end
up as ``(s?(ua)+)?`` by their initials; of the cheapest edits those whose initials are least in ASCII win.

The dynamic program goes over rows; its states are what was written last (nothing, s, u, a), which settles the
role of whatever comes next.  A step takes one macro edit: a run of inserts and the row's own letter.  Macro
edits are prefix-free codes in ASCII order, so texts of as many steps compare as their codes do, and a layer
keeps for each state its cost, the rank of its text among the layer's texts, and in each step the parent it
came from.  No text is kept; the edits are read from the parents afterwards.  Layers up to a constant cost are
few, so each is worked out once.

A conversation of any length is cut into pieces, each a table of (state before, state after) -> (cost, rank).
Pieces are in the order of a range partitioning, so no task gets a conversation as a whole; a scan over the
tables of a conversation's pieces, one short row each, finds the states between them, and each piece is then
traced by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, spread, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
PIECE = 4096
#: Macro edits of one row in ASCII order.  An insert before a deleted row is left out: behind it, it costs the
#: same, leads to the same state and comes sooner in ASCII.  More than two inserts in a row lead to a state that two fewer reach.
CODES = ["D", "IIK", "IIR", "IK", "IR", "K", "R"]
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What completes a conversation after each state: inserts at its end.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: A row's kind is 3 * (initial: s, u, a, other) + (0 sound, 1 truncated, 2 to be deleted).
SOUND, CUT, GONE = range(3)


def _moves(kind: int, state: int) -> list[tuple[int, int, int]]:
    """(code, next state, cost) of each macro edit of a row."""
    initial, fault = divmod(kind, 3)
    out = [(0, state, DELETE)]
    if fault == GONE:
        return out
    for code, text in enumerate(CODES[1:], 1):
        before = state
        for _ in text[:-1]:
            before = NEXT[before]
        cost = INSERT * (len(text) - 1) + (TRUNCATED if fault == CUT else 0)
        if text[-1] == "R":
            out.append((code, NEXT[before], cost + REROLE))
        elif (initial == 0 and before == NOTHING) or (initial == 1 and NEXT[before] == USER) or (initial == 2 and before == USER):
            out.append((code, (SYSTEM, USER, ASSISTANT)[initial], cost + KEEP))
    return out


class Layers:
    """The layers met so far and the steps between them.

    A layer has, for each state before the piece, a row of (cost above the row's least, rank) or None for each
    state now.  ``step`` gives the next layer's number, what to add to each row's cost, and the parents.
    """

    def __init__(self):
        start = tuple(tuple((0, 0) if x == e else None for x in range(4)) for e in range(4))
        self.known, self.layers, self.steps, self.parents = {start: 0}, [start], {}, []

    def step(self, layer: int, kind: int) -> tuple[int, tuple[int, ...], int]:
        found = self.steps.get((layer, kind))
        if found is None:
            found = self.steps[layer, kind] = self._work_out(layer, kind)
        return found

    def _work_out(self, layer: int, kind: int):
        best = []
        for held in self.layers[layer]:
            row: list = [None] * 4
            for x, had in enumerate(held):
                for code, y, cost in _moves(kind, x) if had else ():
                    got = (had[0] + cost, had[1], code, x)
                    if row[y] is None or got < row[y]:
                        row[y] = got
            best.append(row)
        rank = {text: k for k, text in enumerate(sorted({(b[1], b[2]) for row in best for b in row if b}))}
        least = tuple(min(b[0] for b in row if b) for row in best)
        new = tuple(tuple(b and (b[0] - low, rank[b[1], b[2]]) for b in row) for row, low in zip(best, least, strict=True))
        if new not in self.known:
            self.known[new] = len(self.layers)
            self.layers.append(new)
        self.parents.append([[b and (b[3], b[2]) for b in row] for row in best])
        return self.known[new], least, len(self.parents) - 1


LAYERS = Layers()


class Piece:
    """One piece as it is read: its layer, costs and steps."""

    def __init__(self):
        self.layer, self.costs, self.steps = 0, [0] * 4, []

    def add(self, kind: int, n: int) -> None:
        """A row and n - 1 repeats of it, which must be deleted: they cost the same in every state."""
        self.layer, more, step = LAYERS.step(self.layer, kind)
        self.costs = [c + m + DELETE * (n - 1) for c, m in zip(self.costs, more, strict=True)]
        self.steps.append(step)

    def table(self) -> tuple[list, list]:
        """Costs and ranks by 4 * state before + state after, null where no edits lead there."""
        cells = [(c + x[0], x[1]) if x else (None, None) for c, row in zip(self.costs, LAYERS.layers[self.layer], strict=True) for x in row]
        return [c for c, _ in cells], [r for _, r in cells]

    def trace(self, before: int, after: int) -> list[tuple[int, int]]:
        """(code, state before it) of each row on the way from ``before`` to ``after``."""
        out = []
        for step in reversed(self.steps):
            after, code = LAYERS.parents[step][before][after]
            out.append((code, after))
        return out[::-1]


def damage(df: DataFrame) -> DataFrame:
    """Faults by ``crc32("conv_id:turn") % 20`` (nulls as one space) in (conv_id, turn, role, text): 0 drops a
    row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's."""
    blank = lambda c: F.coalesce(c, F.lit(" "))
    key = F.concat(blank(F.col("conv_id").cast("string")), F.lit(":"), blank(F.col("turn").cast("string")))
    text = blank(F.col("text"))
    told = df.withColumn("fault", F.crc32(key.cast("binary")) % 20).where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(blank(F.col("role"))).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return told.drop("copy")


@dataclass
class Repair:
    """What ``repair`` found: ``turns`` (conv_id, piece, k, edit, role, text), the repaired rows in the order of
    (piece, k), and ``report``, a row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit."""

    turns: DataFrame
    report: DataFrame


def _keyed(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(column(c), F.lit(" ")) for c in (role_col, text_col))
    conv = column(conv_col)
    content = F.concat(F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit("-")), F.lit("\n"), F.char_length(role).cast("string"), F.lit(":"), role, text)
    first = F.substring(role, 1, 1)
    ends = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return df.select(
        conv.alias("conv_id"),
        column(turn_col).alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("said"),
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"),
        F.when(ends == "", 2).when(F.substring(ends, -1, 1).isin(".", "!", "?"), 0).otherwise(1).alias("state"),
    )


def _at() -> list:
    """A turn as two columns without nulls, to join by."""
    return [F.coalesce(F.col("turn"), F.lit(0)).alias("at"), F.col("turn").isNull().alias("nowhere")]


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_rows: int = PIECE) -> Repair:
    """Find and apply the cheapest edits of each conversation of ``df``.

    Rows go by turn, nulls first, ties by the SHA-256 of role and text; equal rows of one turn stand together.
    Null roles and texts are one space; the rows of a null id are one conversation.  A row's first fault counts:
    blank, duplicate (role and text seen earlier in the conversation), truncated.  A role that is empty or has
    another initial can't be kept.  Other columns are left out; an empty table gives empty results.  ``gaps``
    counts turns missing between the least and the largest, 0 without any.

    Rows without their texts are counted by equal rows, so repeats are added up before they are shuffled, and
    partitioned by ranges of (conversation, turn, text); texts are shuffled once, to the rows that stay.
    The plan of edits is written to the shared folder.  A task holds ``piece_rows`` rows without texts.
    """
    keyed = _keyed(df, conv_col, turn_col, role_col, text_col)
    groups = keyed.groupBy("conv_id", "turn", "said", "initial", "state").agg(F.count("*").alias("n"))
    firsts = groups.where("state <> 2").groupBy("said").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    seen = groups.join(firsts, "said", "left").withColumn("again", F.col("first").isNotNull() & (F.struct("turn") != F.col("first")))
    seen = seen.withColumn("kind", (F.col("initial") * 3 + F.when(F.col("again"), GONE).otherwise(F.col("state"))).cast("int"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "said"]
    flat = seen.select(*order, "initial", "state", "again", "n", "kind").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = T.StructType([T.StructField(f.name, f.dataType) for f in flat.schema])
    plan = T.StructType([*rows, T.StructField("piece", T.LongType()), T.StructField("i", T.LongType()), T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("ranks", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("illegal", T.LongType())])
    cut = written(flat.mapInArrow(partial(_cut, piece_rows), plan), "edits")
    tables = cut.where("costs is not null").select("conv_id", "piece", "costs", "ranks", "ends", "illegal")
    scanned = spread(tables, "conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_scan, T.StructType([rows["conv_id"], *[T.StructField(n, T.LongType()) for n in ("piece", "before", "after", "last", "cost", "illegal")]]))
    scanned = written(scanned, "states")
    heads = scanned.select("conv_id", "piece", F.lit(-1).cast("long").alias("i"), "before", "after", "last")
    body = cut.where("kind is not null").select("conv_id", "piece", "i", "turn", "said", "n", "kind")
    traced = spread(body.unionByName(heads, allowMissingColumns=True), "piece").sortWithinPartitions("piece", "i")
    edits = written(traced.mapInArrow(_trace, T.StructType([rows["conv_id"], rows["turn"], T.StructField("piece", T.LongType()), T.StructField("k", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("said", T.BinaryType()), T.StructField("audit", T.StringType())])), "traced")

    texts = keyed.groupBy("said", *_at()).agg(F.first("role").alias("old_role"), F.first("text").alias("text"))
    kept = edits.where("edit in ('K', 'R')").select("conv_id", "piece", "k", "edit", F.col("role").alias("new_role"), "said", *_at()).join(texts, ["said", "at", "nowhere"])
    kept = kept.select("conv_id", "piece", "k", "edit", F.coalesce("new_role", "old_role").alias("role"), "text")
    turns = kept.unionByName(edits.where("edit = 'I'").select("conv_id", "piece", "k", "edit", "role", F.lit("").alias("text")))

    body = cut.where("kind is not null")
    zero = F.lit(0).cast("long")
    counts = body.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("state") == 2, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("state") == 2, 0).otherwise(F.col("n") - 1 + F.col("again").cast("long"))).alias("duplicate"),
        F.sum(((F.col("state") == 1) & ~F.col("again")).cast("long")).alias("truncated"),
    ).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), zero).cast("long").alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    costs = scanned.select("conv_id", "cost", "illegal")
    audits = edits.where("audit is not null").select("conv_id", "piece", "audit")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = counts.unionByName(costs, allowMissingColumns=True).unionByName(audits, allowMissingColumns=True)
    report = whole.groupBy("conv_id").agg(
        *[F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in numbers],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("piece", "audit")))), lambda x: x.audit), "").alias("audit"),
    )
    return Repair(turns, report)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _cut(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the pieces of a partition's sorted rows; behind each, a row with its table."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    fields = None
    piece, conv, size, ends, illegal = None, None, 0, [3, 3], 0

    def close():
        costs, ranks = piece.table()
        return (conv, *[None] * (len(fields) - 7), number, None, costs, ranks, ends, illegal)

    for b in batches:
        if fields is None:
            fields = pa.schema([*[f.with_nullable(True) for f in b.schema], ("piece", pa.int64()), ("i", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("illegal", pa.int64())])
        columns = {c: b.column(c).to_pylist() for c in ("conv_id", "kind", "n", "initial")}
        pieces, places, closed = [], [], []
        for c, kind, n, initial in zip(*columns.values(), strict=True):
            if piece is None or c != conv or size == most:
                if piece is not None:
                    closed.append(close())
                    number += 1
                piece, conv, size, ends, illegal = Piece(), c, 0, [initial, initial], 0
            else:
                illegal += not _legal(ends[1], initial)
            illegal += n - 1
            piece.add(kind, n)
            piece.steps.clear()
            pieces.append(number)
            places.append(size)
            size, ends = size + 1, [ends[0], initial]
        empty = [pa.nulls(b.num_rows, f.type) for f in list(fields)[-4:]]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, pa.int64()), pa.array(places, pa.int64()), *empty], schema=fields)
        if closed:
            yield _batch(closed, fields)
    if piece is not None:
        yield _batch([close()], fields)


def _legal(a: int, b: int) -> bool:
    """Initials that may stand side by side: su, ua, au."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and after each piece on the cheapest way through its conversation.

    Holds a number and four parents for each piece of one conversation, a few bytes for 4,096 rows.
    """
    names = ("piece", "before", "after", "last", "cost", "illegal")
    fields, conv, open_, ends, illegal = None, None, False, None, 0
    held: list = [(0, 0), None, None, None]
    pieces: list[int] = []
    parents = bytearray()

    def close():
        final = {x: (held[x][0] + INSERT * len(CLOSING[x]), held[x][1]) for x in range(4) if held[x]}
        at = min(final, key=lambda x: final[x])
        cost, rows = final[at][0], []
        for k in range(len(pieces) - 1, -1, -1):
            before = parents[4 * k + at]
            last = k == len(pieces) - 1
            rows.append((conv, pieces[k], before, at, int(last), cost if last else 0, illegal if last else 0))
            at = before
            if len(rows) == 10_000:
                yield rows
                rows = []
        yield rows

    for b in batches:
        fields = fields or pa.schema([b.schema.field("conv_id"), *[(n, pa.int64()) for n in names]])
        done = []
        for c, piece, costs, ranks, own, inside in zip(*[b.column(n).to_pylist() for n in ("conv_id", "piece", "costs", "ranks", "ends", "illegal")], strict=True):
            if not open_ or c != conv:
                if open_:
                    for rows in close():
                        done.extend(rows)
                        if len(done) >= 10_000:
                            yield _batch(done, fields)
                            done = []
                conv, open_, held, pieces, parents, illegal = c, True, [(0, 0), None, None, None], [], bytearray(), 0
            else:
                illegal += not _legal(ends[1], own[0])
            illegal, ends = illegal + inside, own
            best: list = [None] * 4
            for e in range(4):
                for x in range(4) if held[e] else ():
                    if costs[4 * e + x] is not None:
                        got = (held[e][0] + costs[4 * e + x], held[e][1], ranks[4 * e + x], e)
                        if best[x] is None or got < best[x]:
                            best[x] = got
            order = {t: k for k, t in enumerate(sorted({(g[1], g[2]) for g in best if g}))}
            held = [g and (g[0], order[g[1], g[2]]) for g in best]
            pieces.append(piece)
            parents += bytes(g[3] if g else 0 for g in best)
        if done:
            yield _batch(done, fields)
    if open_:
        for rows in close():
            if rows:
                yield _batch(rows, fields)


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each piece: a row for each turn that is kept, changed or put in, and one with the piece's letters."""
    fields, head, rows = None, None, []

    def close():
        conv, piece, before, after, last = head
        found = Piece()
        for *_, n, kind in rows:
            found.add(kind, n)
        out, letters = [], []
        state = before
        for (turn, said, n, _), (code, state) in zip(rows, found.trace(before, after), strict=True):
            for letter in CODES[code]:
                if letter == "D":
                    continue
                new = NEXT[state]
                out.append((conv, None if letter == "I" else turn, piece, len(out), letter, None if letter == "K" else ROLE[new], None if letter == "I" else said, None))
                state = new
            letters.append(CODES[code] + "D" * (n - 1))
        state = after
        for letter in CLOSING[after] if last else "":
            state = NEXT[state]
            out.append((conv, None, piece, len(out), letter, ROLE[state], None, None))
            letters.append(letter)
        out.append((conv, None, piece, len(out), None, None, None, "".join(letters)))
        return out

    for b in batches:
        fields = fields or pa.schema([b.schema.field("conv_id"), b.schema.field("turn"), ("piece", pa.int64()), ("k", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("said", pa.binary()), ("audit", pa.string())])
        done = []
        for conv, piece, i, turn, said, n, kind, before, after, last in zip(*[b.column(c).to_pylist() for c in ("conv_id", "piece", "i", "turn", "said", "n", "kind", "before", "after", "last")], strict=True):
            if i < 0:
                if head is not None:
                    done.extend(close())
                head, rows = (conv, piece, before, after, last), []
            else:
                rows.append((turn, said, n, kind))
        if done:
            yield _batch(done, fields)
    if head is not None:
        yield _batch(close(), fields)


def digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the repaired ``role:text``, joined by line feeds.

    SHA-256 goes over a text from end to end, so the rows of a conversation pass through one task; they are
    sorted there by Spark, which spills, and only the running hash is kept.
    """
    said = F.concat(F.col("role"), F.lit(":"), F.col("text")).cast("binary").alias("said")
    rows = spread(turns.select("conv_id", "piece", "k", said), "conv_id").sortWithinPartitions("conv_id", "piece", "k").select("conv_id", "said")
    return rows.mapInArrow(_hash, T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, running, fields = None, None, None
    for b in batches:
        fields = fields or pa.schema([b.schema.field("conv_id"), ("repaired_sha256", pa.string())])
        done, said = [], b.column("said")
        for k, c in enumerate(b.column("conv_id").to_pylist()):
            if running is None or c != conv:
                if running is not None:
                    done.append((conv, running.hexdigest()))
                conv, running = c, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(said[k].as_buffer())
        if done:
            yield _batch(done, fields)
    if running is not None:
        yield _batch([(conv, running.hexdigest())], fields)


def damaged_and_repaired(df: DataFrame) -> DataFrame:
    """Damage (conv_id, turn, role, text), repair it and report on every conversation of the undamaged rows."""
    done = repair(damage(df))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = df.select("conv_id").distinct()
    parts = every.unionByName(done.report, allowMissingColumns=True).unionByName(digests(done.turns), allowMissingColumns=True)
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


#: DuckDB SQL for ``damaged_and_repaired(conversations)``: the same edits by whole texts in a recursion over rows.
SQL_REPAIRED = r"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
faulty AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
    FROM keyed, crc),
damaged AS (
    SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM faulty, range(2) c(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(coalesce('c' || CAST(conv_id AS VARCHAR), '-') || chr(10) || CAST(length(role) AS VARCHAR) || ':' || role || text)) AS k
    FROM damaged),
told AS (
    SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS above,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
            WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM numbered),
inserts(state, made, mid, cost, said) AS (VALUES
    (0, '', 0, 0, ''), (0, 'I', 2, 5, '\user:'), (0, 'II', 3, 10, '\user:\assistant:'),
    (1, '', 1, 0, ''), (1, 'I', 2, 5, '\user:'), (1, 'II', 3, 10, '\user:\assistant:'),
    (2, '', 2, 0, ''), (2, 'I', 3, 5, '\assistant:'), (2, 'II', 2, 10, '\assistant:\user:'),
    (3, '', 3, 0, ''), (3, 'I', 2, 5, '\user:'), (3, 'II', 3, 10, '\user:\assistant:')),
best AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': ''} AS b FROM (SELECT DISTINCT conv_id FROM damaged)
    UNION ALL
    SELECT conv_id, k, state, min(b) FROM (
        SELECT t.conv_id, t.k, CASE e.edit WHEN 'D' THEN i.mid WHEN 'K' THEN CASE t.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE i.mid WHEN 2 THEN 3 ELSE 2 END END AS state,
            {'cost': best.b.cost + i.cost + e.cost + CASE WHEN t.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END,
            'audit': best.b.audit || i.made || e.edit,
            'said': best.b.said || replace(i.said, '\', chr(10)) || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || t.role || ':' || t.text
                ELSE chr(10) || CASE i.mid WHEN 2 THEN 'assistant:' ELSE 'user:' END || t.text END} AS b
        FROM best JOIN told t ON t.conv_id IS NOT DISTINCT FROM best.conv_id AND t.k = best.k + 1 JOIN inserts i ON i.state = best.state
        JOIN (VALUES ('D', 2), ('K', 0), ('R', 1)) e(edit, cost) ON e.edit = 'D' OR (t.fault NOT IN ('blank', 'duplicate')
            AND (e.edit = 'R' OR (t.initial = 's' AND i.mid = 0) OR (t.initial = 'u' AND i.mid <> 2) OR (t.initial = 'a' AND i.mid = 2)))
    ) GROUP BY conv_id, k, state),
counts AS (
    SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (above IS NOT NULL AND above || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
    FROM told GROUP BY conv_id),
ended AS (
    SELECT best.conv_id, min({'cost': b.cost + i.cost, 'audit': b.audit || i.made, 'said': b.said || replace(i.said, '\', chr(10))}) AS b
    FROM best JOIN counts c ON c.conv_id IS NOT DISTINCT FROM best.conv_id AND c.n = best.k JOIN inserts i ON i.state = best.state AND i.mid IN (0, 3)
    GROUP BY best.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(substr(b.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
