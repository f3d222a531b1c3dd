"""Substring deduplication by suffix sorting with a difference cover.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.  Suffixes are dealt to
tasks by content: of the k-grams inside the string at a position, the least by hash (its anchor) depends on
the string alone, so equal strings have equal anchors, and a position whose anchor's k-gram occurs once in
all documents starts no repeated string.  The bytes around the other anchors are gathered by k-gram; each
task sorts their suffixes by the difference-cover algorithm - sort sampled triples, recurse on their names,
merge the remaining suffixes - and compares the prefixes of adjacent suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import spread, tidy, utf8, written

#: HOT: occurrences of a k-gram beyond which its positions are dealt again; one task sorts at most as many windows of under 2 * LENGTH bytes at once.
LENGTH, GRAM, HOT, BLOCK = 200, 32, 800, 17
MIX = np.uint64(0x9E3779B97F4A7C15)


# ---- suffix sorting -------------------------------------------------------------------------------------------------


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, names, distinct names) of rows, by the columns in turn; names are ranks from 1."""
    key = columns[0].astype(np.uint64)
    for c in columns[1:]:
        size = np.uint64(int(c.max()) + 1)
        if int(key.max()) >= (1 << 63) // int(size):
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = key * size + c.astype(np.uint64)
    order = np.argsort(key)  # equal rows share a name, so their order is free
    new = np.empty(len(key), bool)
    new[:1] = True
    sorted_ = key[order]
    new[1:] = sorted_[1:] != sorted_[:-1]
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(new)
    return order, names, int(new.sum())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of the non-negative numbers ``s`` in the order of their suffixes, by the difference cover {1, 2} mod 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64) + 1, np.zeros(3, np.int64)])  # 0 ends every suffix
    extra = n % 3 == 1  # so that the last triple of residue 1 ends with an end mark
    one, two = np.arange(1, n + extra, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    _, names, distinct = _names([t[sample], t[sample + 1], t[sample + 2]])
    if distinct == len(sample):
        sorted_sample = sample[np.argsort(names)]
    else:
        sorted_sample = sample[suffix_array(names)]
    rank = np.zeros(n + 4, np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    top = np.uint64(len(sample) + 2)
    pair = lambda i: t[i].astype(np.uint64) * top + rank[i + 1].astype(np.uint64)
    order0, _, _ = _names([t[rest], rank[rest + 1]])
    zero = rest[order0]
    is_one = sorted_sample % 3 == 1
    ones, twos = sorted_sample[is_one], sorted_sample[~is_one]
    # A remaining suffix is compared with one of residue 1 by (number, rank), with one of residue 2 by (number, number, rank).
    below1 = np.searchsorted(pair(ones), pair(zero))
    heads = np.unique(t[np.concatenate([zero, twos])] * (int(t.max()) + 1) + t[np.concatenate([zero, twos]) + 1], return_inverse=True)[1].astype(np.uint64)
    triple0 = heads[: len(zero)] * top + rank[zero + 2].astype(np.uint64)
    triple2 = heads[len(zero) :] * top + rank[twos + 2].astype(np.uint64)
    below2 = np.searchsorted(triple2, triple0)
    out = np.empty(n, np.int64)
    out[np.arange(len(zero)) + below1 + below2] = zero
    before = np.empty(len(sorted_sample), np.int64)
    before[is_one] = np.searchsorted(pair(zero), pair(ones))
    before[~is_one] = np.searchsorted(triple0, triple2)
    out[np.arange(len(sorted_sample)) + before] = sorted_sample
    return out


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, which of its positions start a string of ``length`` bytes that starts elsewhere in the parts too."""
    n = sum(map(len, parts)) + len(parts)
    text, ends = np.empty(n, np.int64), np.empty(n, np.int64)
    at = 0
    for k, p in enumerate(parts):
        text[at : at + len(p)] = np.frombuffer(p, np.uint8)
        text[at + len(p)] = 256 + k  # ends differ, so no match crosses them
        ends[at : at + len(p) + 1] = at + len(p)
        at += len(p) + 1
    order = suffix_array(text)
    order = order[ends[order] - order >= length]
    word, k = text.astype(np.uint64) & np.uint64(255), 1  # the 8 bytes from each position on; strings compared hold no end
    while k < 8:
        word[:-k] |= word[k:] << np.uint64(8 * k)
        k *= 2
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    for j in [*range(0, length - 8, 8), length - 8]:
        live = live[word[a[live] + j] == word[b[live] + j]]
    same = np.zeros(len(a), bool)
    same[live] = True
    hit = np.zeros(n, bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    out, at = [], 0
    for p in parts:
        out.append(hit[at : at + len(p)])
        at += len(p) + 1
    return out


# ---- anchors --------------------------------------------------------------------------------------------------------


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``gram``-byte string (a power of two), by doubling."""
    h, k = np.frombuffer(data, np.uint8).astype(np.uint64) * MIX + np.uint64(1), 1
    while k < gram:
        h = h[:-k] * np.uint64(0xD6E8FEB86659FD93) + h[k:]
        h ^= h >> np.uint64(31)
        h *= MIX
        k *= 2
    return h


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash of its k-gram, first, last position it serves), by position; nothing for shorter data.

    A position's anchor is the least k-gram, by the hash's upper bits and then by place, of those within its
    string of ``length`` bytes.
    """
    n, w = len(data), length - gram + 1
    if n < length:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none
    chosen, grams, step = [], [], 1 << 17
    for a in range(0, n - length + 1, step):
        part = gram_hashes(data[a : a + step + length - 1], gram)
        count = len(part) - w + 1
        key = (part & ~np.uint64(0xFFFFF)) | np.arange(len(part), dtype=np.uint64)
        block = np.concatenate([key, np.full(-len(key) % w, ~np.uint64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & np.uint64(0xFFFFF)).astype(np.int64)
        chosen.append(at + a)
        grams.append(part[at])
    chosen, grams = np.concatenate(chosen), np.concatenate(grams)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(chosen) - 1]])
    return chosen[first], grams[first], first, last


def _span_bytes(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@F.pandas_udf(BinaryType())
def packed(data: pd.Series) -> pd.Series:
    """Bytes, compressed for the shuffles."""
    c = zstandard.ZstdCompressor(level=1)
    return data.map(c.compress)


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``texts`` (tid, tie long, data binary; equal pairs mean equal data) -> ``(tid, tie, hits)``.

    Each hit has the start of a window and, from there, the runs [from, to) of positions at which a repeated
    string starts; texts without any have no row.  Copies of a text count as other places.
    """

    def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part, places, hashes = batch.slice(k, 1000), [], []
                for data in part.column(2):
                    at, h, _, _ = anchors(data.as_py(), length, gram)
                    places.append(at.astype(np.int32))
                    hashes.append(h.view(np.int64))
                if sum(map(len, places)):
                    rows = pa.array(np.repeat(np.arange(len(places)), list(map(len, places))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(places))], names=["gram", "tid", "tie", "at"])

    marks = written(texts.mapInArrow(tidy(emit_anchors), "gram long, tid long, tie long, at int"), "marks")
    place = F.xxhash64("tid", "tie", "at")
    often = marks.groupBy("gram").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).where("n > 1")
    often = written(often.select("gram", "n", (F.col("a") == F.col("b")).alias("alone")), "often")
    # A k-gram at one place of one text only, but of several copies of it, needs no sorting: those texts go whole.
    places = marks.join(often.where("not alone"), "gram").groupBy("tid", "tie").agg(F.collect_set(F.struct("at", "n")).alias("places"))
    ready = spread(texts.select("tid", "tie", packed("data").alias("data")).join(places, ["tid", "tie"]), "tid", "tie").sortWithinPartitions("tid", "tie").select("tid", "tie", "data", F.col("places.at").alias("at"), F.col("places.n").alias("n"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out, size = None, [], 0

        def made() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["gram", "sub", "back", "bytes", "tid", "tie", "starts"])

        for batch in batches:
            for tid, tie, data, known, counts in zip(*(batch.column(c) for c in range(5)), strict=True):
                if (key := (tid.as_py(), tie.as_py())) == before:
                    continue
                before, data = key, zstandard.decompress(data.as_py())
                wanted = dict(zip(known.as_py(), counts.as_py(), strict=True))
                at, h, first, last = anchors(data, length, gram)
                keep = np.isin(at, np.fromiter(wanted, np.int64, len(wanted)))
                rows: dict[tuple, list[int]] = {}
                for a, g, lo, hi in zip(at[keep].tolist(), h[keep].view(np.int64).tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                    if wanted[a] <= hot:
                        rows.setdefault((g, 0, a - lo, data[lo : hi + length]), []).append(lo)
                        continue
                    # A hot k-gram's positions are dealt by their distance to it and by what their strings share.
                    for d in range((a - hi) // BLOCK, (a - lo) // BLOCK + 1):
                        p, q = max(lo, a - (d + 1) * BLOCK + 1), min(hi, a - d * BLOCK)
                        core = data[a - d * BLOCK : a - (d + 1) * BLOCK + 1 + length]
                        sub = int.from_bytes(hashlib.blake2b(core, digest_size=7).digest(), "big") + 1
                        rows.setdefault((g, d * (1 << 56) + sub, a - p, data[p : q + length]), []).append(p)
                out += [(*k, *key, v) for k, v in rows.items()]
                size += sum(len(k[3]) for k in rows)
                if size > 2 << 20:
                    yield made()
                    size = 0
        if out:
            yield made()

    cut = ready.mapInArrow(tidy(windows), "gram long, sub long, back int, bytes binary, tid long, tie long, starts array<int>")
    cut = written(cut.withColumn("wid", F.xxhash64("back", "bytes")), "windows")  # of one k-gram; joined by all three keys
    # Equal windows are one part, of which one copy is sorted.
    parts = cut.groupBy("gram", "sub", "wid").agg(F.sum(F.size("starts")).alias("n"), F.first("bytes").alias("bytes"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key = 0, None
        for batch in batches:
            for g, sub, wid, n, data in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if size > 1 << 16 and (g, sub) != key:  # small texts stay in the processor's cache
                    yield from sorted_(held)
                    held, size = [], 0
                key = (g, sub)
                held.append((g, sub, wid, n, data))
                size += len(data)
        if held:
            yield from sorted_(held)

    def sorted_(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, runs, several, single = [], [], {}, {r[:2] for r in held if r[3] == 1}
        for row in held:
            several[row[:2]] = several.get(row[:2], 0) + 1
        open_ = [r for r in held if several[r[:2]] > 1 and r[:2] in single]
        for r in held:
            if r[3] > 1:  # every string of a repeated window is repeated
                keys.append(r[:3])
                runs.append([0, len(r[4]) - length + 1])
        if open_:
            for r, hit in zip(open_, repeated_starts([r[4] for r in open_], length), strict=True):
                if r[3] == 1 and hit.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
                    keys.append(r[:3])
                    runs.append(edges)
        if keys:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*keys, strict=True)), pa.array(runs, pa.list_(pa.int32()))], names=["gram", "sub", "wid", "runs"])

    found = written(spread(parts, "gram", "sub").sortWithinPartitions("gram", "sub").select("gram", "sub", "wid", "n", "bytes").mapInArrow(tidy(solve), "gram long, sub long, wid long, runs array<int>"), "found")
    hits = cut.select("gram", "sub", "wid", "tid", "tie", "starts").join(found, ["gram", "sub", "wid"]).select("tid", "tie", F.explode("starts").alias("start"), "runs")
    return hits.groupBy("tid", "tie").agg(F.collect_list(F.struct("start", "runs")).alias("hits"))


def drop_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(<id_col>, n_bytes, n_removed, n_spans, kept)`` of every row; ``kept`` are the remaining bytes.

    Null text counts as empty; texts under ``length`` bytes keep everything; equal texts of ``length`` bytes
    or more (repeated rows too) all go whole.  Texts are told apart by 128 bits of hashes.  Other columns are
    not read.
    """
    rows = df.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("data")).withColumns({"tid": F.xxhash64("data"), "tie": F.xxhash64(F.lit(1), "data"), "size": F.octet_length("data")})
    long_ = rows.where(F.col("size") >= length).select("tid", "tie", "data")
    copies = long_.groupBy("tid", "tie").agg(F.count("*").alias("n")).where("n > 1").select("tid", "tie", F.lit(True).alias("whole"))
    marks = repeated_spans(long_, length, gram, hot)
    known = marks.join(copies, ["tid", "tie"], "full_outer").select("tid", "tie", "hits", F.coalesce("whole", F.lit(False)).alias("whole"))
    ready = rows.withColumn("data", packed("data")).join(known, ["tid", "tie"], "left").select("id", "data", F.coalesce("whole", F.lit(False)).alias("whole"), F.col("hits.start").alias("starts"), F.col("hits.runs").alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                out = []
                for data, whole, starts, runs in zip(*(part.column(c).to_pylist() for c in range(1, 5)), strict=True):
                    data = zstandard.decompress(data)
                    n = len(data)
                    if whole and n >= length:
                        spans = [(0, n)]
                    else:
                        spans = _span_bytes([(s + a, s + b - 1 + length) for s, r in zip(starts or [], runs or [], strict=True) for a, b in zip(r[::2], r[1::2], strict=True)])
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(data[at:a])
                        at = b
                    kept.append(data[at:])
                    out.append((n, sum(b - a for a, b in spans), len(spans), b"".join(kept)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    return ready.mapInArrow(tidy(finish), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


#: DuckDB SQL for ``drop_repeated`` over documents: every string of 200 bytes, in hexadecimal, by its hash.
SQL_CUT = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
blocks AS (SELECT doc_id, b, substr(h, 2000 * b + 1, 2398) AS part, least(1000, n - 199 - 1000 * b) AS many FROM (SELECT *, unnest(range(0, (n - 200) // 1000 + 1)) AS b FROM d WHERE n >= 200)),
starts AS (SELECT doc_id, 1000 * b + o AS p, md5_number(substr(part, 2 * o + 1, 400)) AS m FROM (SELECT *, unnest(range(0, many)) AS o FROM blocks)),
again AS (SELECT doc_id, p FROM starts WHERE m IN (SELECT m FROM starts GROUP BY m HAVING count(*) > 1)),
edges AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) + 200 AS new FROM again),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (SELECT doc_id, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM edges) GROUP BY doc_id, g),
runs AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS gone FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(starts), 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda k: substr(h, CASE WHEN k = 0 THEN 1 ELSE 2 * ends[k] + 1 END,
        2 * ((CASE WHEN k = len(starts) THEN n ELSE starts[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE ends[k] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id)
"""
