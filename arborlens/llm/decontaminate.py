"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh, tidy

#: PART: window starts taken at once; CHUNK_BYTES, CHUNK_ITEMS: benchmark indexed at once (each item takes some 60 KB of block tables).
WIDTH, SIMILARITY, RADIUS, BLOCKS, PART, CHUNK_BYTES, CHUNK_ITEMS = 5, 0.8, 19, 4, 1 << 12, 2 << 20, 2500
RESULT = "item_id long, similarity double, start_word long, n_words long"
WORDS = re.compile(r"\w+").findall


def shingles(words: list[str], width: int = WIDTH) -> list[str]:
    """The ``width``-word shingles; of fewer words, the whole sequence."""
    if len(words) <= width:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def weight(shingle: str) -> int:
    """A shingle weighs as many as it has characters besides spaces."""
    return len(shingle) - shingle.count(" ")


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two shingle bags."""
    if len(b) < len(a):
        a, b = b, a
    low = sum(weight(s) * min(n, b[s]) for s, n in a.items() if s in b)
    high = sum(weight(s) * n for bag in (a, b) for s, n in bag.items()) - low
    return low / high if high else 0.0


def _planes(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signed, weighted bit columns of each shingle, shape (n, 64), and the weights."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, items), np.uint64, len(items)).astype(">u8")
    w = np.fromiter(map(weight, items), np.int64, len(items))
    return (np.unpackbits(h.view(np.uint8)).reshape(-1, 64).astype(np.int64) * 2 - 1) * w[:, None], w


def _words64(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


@functools.cache
def near_masks(bits: int, radius: int) -> np.ndarray:
    """All ``bits``-bit numbers with at most ``radius`` bits set: what a block may differ by."""
    x = np.arange(1 << bits, dtype=np.uint64)
    return x[np.bitwise_count(x) <= radius].astype(np.uint16)


class Blocks:
    """Multi-index of 64-bit fingerprints: one table for each of ``blocks`` blocks of bits.

    Two fingerprints within ``radius`` bits differ by at most radius // blocks in some block.  A table holds
    every value within that distance of a fingerprint's block, sorted, so one lookup for each block finds all
    fingerprints within the radius.
    """

    def __init__(self, prints: np.ndarray, radius: int, blocks: int):
        if 64 % blocks or not 4 <= 64 // blocks <= 16:
            raise ValueError("blocks must be 4, 8 or 16")
        self.prints, self.radius, self.bits = prints, radius, 64 // blocks
        masks, self.tables = near_masks(self.bits, radius // blocks), []
        for k in range(blocks):
            values = (self.part(prints, k)[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], (order // len(masks)).astype(np.int32)))

    def part(self, prints: np.ndarray, k: int) -> np.ndarray:
        return ((prints >> np.uint64(self.bits * k)) & np.uint64((1 << self.bits) - 1)).astype(np.uint16)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index into prints, own row) of the pairs within the radius, each once, and how many pairs the tables gave."""
        found = []
        for k, (values, rows) in enumerate(self.tables):
            mine = self.part(prints, k)
            low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            many = high - low
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            found.append(np.repeat(np.arange(len(prints)), many) * len(self.prints) + rows[at])
        pairs = np.unique(np.concatenate(found))
        w, i = np.divmod(pairs, len(self.prints))
        keep = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
        return w[keep], i[keep], len(pairs)


class Index:
    """Benchmark items of one chunk: by size, a multi-index of their fingerprints; their bags; the words they use."""

    def __init__(self, items: list[tuple[int, str]], width: int, radius: int, blocks: int):
        self.width = width
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, Counter]] = []
        #: Pairs of windows and items met, given by the block tables, and compared exactly.
        self.met = self.given = self.compared = 0
        sizes: dict[int, list[int]] = defaultdict(list)
        starts: dict[int, set[tuple[int, ...]]] = defaultdict(set)
        for item_id, text in items:
            words = WORDS((text or "").lower())
            if not words:
                continue
            sizes[len(words)].append(len(self.items))
            self.items.append((item_id, Counter(shingles(words, width))))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            q = min(width, len(words))
            for i in range(len(ids) - q + 1):
                starts[q].add(tuple(ids[i : i + q]))
        self.starts = {q: np.unique(self._mixed([np.array(c, np.uint64) for c in zip(*s, strict=True)])) for q, s in starts.items()}
        self.sizes = {size: np.array(rows) for size, rows in sorted(sizes.items())}
        self.classes = {}
        for size, rows in self.sizes.items():
            prints = np.concatenate([_words64(_planes(list(self.items[r][1].elements()))[0].sum(axis=0)[None] > 0) for r in rows])
            mass = np.array([sum(weight(s) * n for s, n in self.items[r][1].items()) for r in rows], np.int64)
            self.classes[size] = (Blocks(prints, radius, blocks), mass)

    @staticmethod
    def _mixed(columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def hits(self, ids: np.ndarray, q: int) -> np.ndarray:
        """Where a run of q words that is a shingle of some item may start (a superset, by hash)."""
        if len(ids) < q:
            return np.empty(0, np.int64)
        known = ids > 0
        at = np.flatnonzero(np.logical_and.reduce([known[k : len(ids) - q + 1 + k] for k in range(q)]))
        if not len(at):
            return at
        key, table = self._mixed([ids[at + k].astype(np.uint64) for k in range(q)]), self.starts[q]
        found = np.searchsorted(table, key)
        return at[(found < len(table)) & (table[np.minimum(found, len(table) - 1)] == key)]

    def search(self, text: str, least: float) -> list[tuple[int, float, int, int]]:
        """(item id, best similarity, first word, words) for each item that some window of the text is similar to."""
        words = WORDS(text.lower())
        n, best = len(words), {}
        ids = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), np.int64, n)
        for q in self.starts:
            hits = self.hits(ids, q)
            if not len(hits):
                continue
            sizes = [size for size in self.sizes if min(self.width, size) == q]
            inside = [size for size in sizes if size < n]
            if inside:
                # Windows with a hit lie in the runs of places up to the largest window away from one; a run is taken in parts.
                reach = inside[-1] - q
                ends = np.flatnonzero(np.diff(hits) > 2 * reach + 1)
                for a, b in zip(np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(hits) - 1]]), strict=True):
                    low, high = max(0, int(hits[a]) - reach), min(n - q, int(hits[b]) + reach)
                    for at in range(low, high + 1, PART):
                        self._windows(words, q, hits, at, min(high, at + PART - 1 + reach), at + PART, inside, least, best)
            whole = [size for size in sizes if size >= n]
            if whole:
                self._windows(words, q, hits, 0, n - q, 1, whole, least, best)
        return [(self.items[r][0], *x) for r, x in best.items()]

    def _windows(self, words: list[str], q: int, hits: np.ndarray, low: int, high: int, stop: int, sizes: list[int], least: float, best: dict) -> None:
        """Windows of the sizes (or of the whole text, if it is shorter) over the shingles from low to high that start before ``stop``."""
        own = shingles(words[low : high + q], q)
        planes, heavy = _planes(own)
        sums = np.zeros((len(own) + 1, 64), np.int64)
        np.cumsum(planes, axis=0, out=sums[1:])
        mark = np.zeros(len(own), np.int64)
        mark[hits[(hits >= low) & (hits <= high)] - low] = 1
        count, known, heavy = (np.concatenate([[0], np.cumsum(x)]) for x in (mark, mark * heavy, heavy))
        for size in sizes:
            span = min(size, len(words))
            long = span - q + 1
            at = np.arange(min(stop - low, len(own) - long + 1))
            at = at[count[at + long] > count[at]]  # the others share no shingle with any item
            if not len(at):
                continue
            blocks, mass = self.classes[size]
            w, i, given = blocks.near(_words64(sums[at + long] > sums[at]))
            self.met, self.given = self.met + len(at) * len(mass), self.given + given
            # Shared weight is at most that of the window's shingles known from some item.
            have, all_ = known[at + long] - known[at], heavy[at + long] - heavy[at]
            most = np.minimum(have[w], mass[i])
            most = most / (all_[w] + mass[i] - most)
            for k in np.lexsort((at[w], -most)).tolist():
                row = int(self.sizes[size][i[k]])
                if most[k] < least - 1e-9 or (row in best and most[k] <= best[row][0]):
                    continue
                self.compared += 1
                s = similarity(Counter(own[at[w[k]] : at[w[k]] + long]), self.items[row][1])
                if s >= least and (row not in best or s > best[row][0]):
                    best[row] = (s, low + int(at[w[k]]), span)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, chunk_bytes: int = CHUNK_BYTES, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """``(<id_col>, item_id, similarity, start_word, n_words)``: one row per document and benchmark item found in it.

    Words are ``\\w+`` of the lower-cased text.  A window of as many words as the item (the whole text if it
    is shorter) matches if its SimHash is within ``radius`` bits of the item's and the weighted Jaccard
    similarity of their ``width``-word shingles is ``least`` or more; the best window of an item is reported,
    of equal ones the first.  Windows that share no shingle with any item have similarity 0 and are passed
    over; of the others, the fingerprints are looked up in the block tables of their size, and what the tables
    give within the radius is compared exactly.  Items are sent to the executors in chunks of ``chunk_bytes``
    of text and ``chunk_items`` items on average (a larger benchmark takes more passes over the documents); items and texts that
    are null or without words match nothing.  Repeated rows give repeated results; repeated items with one
    id are reported once per document.  Other columns of ``docs`` are not read.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("item")).where("item is not null")
    size, n = items.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0)), F.count("*")).first()
    chunks = max(1, math.ceil(size / chunk_bytes), math.ceil(n / chunk_items))
    spark, out = docs.sparkSession, []
    for k in range(chunks):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == k).collect()]
        if part or not out:
            out.append(_search(docs, spark.sparkContext.broadcast(part), id_col, text_col, width, least, radius, blocks))
    return reduce(DataFrame.unionAll, out)


def _search(docs: DataFrame, part, id_col: str, text_col: str, width: int, least: float, radius: int, blocks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(part.value, width, radius, blocks)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some, at, found = batch.slice(k, 1000), [], []
                for r, text in enumerate(some.column(1)):
                    best: dict = {}
                    for x in index.search(text.as_py() or "", least):
                        if x[0] not in best or (-x[1], x[2]) < (-best[x[0]][1], best[x[0]][2]):
                            best[x[0]] = x
                    at += [r] * len(best)
                    found += best.values()
                if found:
                    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True))], schema=done)

    fields = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL(RESULT).fields])
    done = to_arrow_schema(fields)
    return docs.select(id_col, text_col).mapInArrow(tidy(run), fields)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents in which a benchmark item was found.

    Rows with an id that was found go, of a null id all rows if any of them holds an item.  Columns are those of ``docs``.
    """
    name = fresh(docs, "found")
    found = contaminated(docs, benchmark, id_col, **options).select(F.col(id_col).alias(name)).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


#: DuckDB SQL for ``contaminated`` over documents and benchmark, by all windows and without any filter but shared shingles.
SQL_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, ws, len(ws) AS size, least(5, len(ws)) AS q FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM benchmark WHERE text IS NOT NULL) WHERE len(ws) > 0),
ds AS (SELECT doc_id, q, n, unnest(range(0, n - q + 1)) AS p, unnest(list_transform(range(1, n - q + 2), lambda i: array_to_string(ws[i:i + q - 1], ' '))) AS sh
    FROM (SELECT *, len(ws) AS n FROM d, (SELECT DISTINCT q FROM b)) WHERE n >= q),
bs AS (SELECT item_id, size, q, sh, count(*) AS c, length(replace(sh, ' ', '')) AS w FROM (
    SELECT item_id, size, q, unnest(list_transform(range(1, size - q + 2), lambda i: array_to_string(ws[i:i + q - 1], ' '))) AS sh FROM b) GROUP BY ALL),
mass AS (SELECT item_id, sum(c * w) AS m FROM bs GROUP BY item_id),
starts AS (SELECT DISTINCT doc_id, item_id, q, least(size, n) AS span, unnest(range(CASE WHEN n > size THEN greatest(0, p - (size - q)) ELSE 0 END, CASE WHEN n > size THEN least(p, n - size) ELSE 0 END + 1)) AS s
    FROM ds JOIN bs USING (q, sh)),
bags AS (SELECT doc_id, item_id, s, span, sh, count(*) AS c FROM starts JOIN ds USING (doc_id, q) WHERE p BETWEEN s AND s + span - q GROUP BY ALL),
sums AS (SELECT doc_id, item_id, s, span, sum(bags.c * length(replace(sh, ' ', ''))) AS m1, sum(CASE WHEN bs.c IS NULL THEN 0 ELSE least(bags.c, bs.c) * bs.w END) AS low
    FROM bags LEFT JOIN bs USING (item_id, sh) GROUP BY ALL),
likeness AS (SELECT doc_id, item_id, s, span, CAST(low AS DOUBLE) / CAST(m1 + m - low AS DOUBLE) AS similarity FROM sums JOIN mass USING (item_id))
SELECT doc_id, item_id, similarity, s AS start_word, CAST(span AS BIGINT) AS n_words FROM likeness WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1
"""
