"""Substring deduplication over runs of consecutive sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, written

RUN, MIN_WORDS = 2, 12
ENDS = re.compile(r"[.!?][\"')\]]*\s+|\n\s*")
LAST = (1 << 63) - 1


def sentences(text: str) -> list[str]:
    """The text cut after sentence ends and line feeds; the pieces joined are the text."""
    cuts = [0, *(m.end() for m in ENDS.finditer(text))]
    if cuts[-1] != len(text):
        cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def runs(text: str, run: int = RUN, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, end, digest) of the shortest runs from and up to each sentence with enough sentences and words.

    These cover what all runs cover: in a repeated run, a sentence with too little after it is in the shortest
    run up to the last one.  Sentences compare lower-cased with white space as one space.  A text of fewer than
    ``run`` sentences is one run if it has ``min_words`` words.
    """
    words = [s.lower().split() for s in sentences(text)]
    keys = [" ".join(w) for w in words]
    sums = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).tolist() if words else [0]
    n, j, need = len(words), 0, min(run, len(words))
    digest = lambda i, j: xxhash.xxh3_128_digest(" ".join(keys[i:j]).encode("utf-8", "surrogatepass"))
    ends = []
    for i in range(n):
        j = max(j, i + need)
        while j <= n and sums[min(j, n)] - sums[i] < min_words:
            j += 1
        if j > n:
            break
        ends.append(j)
        yield i, j, digest(i, j)
    i = 0
    for j in range(ends[0] if ends else n + 1, n + 1):
        while i + 1 < len(ends) and ends[i + 1] <= j:
            i += 1
        if ends[i] != j:
            yield i, j, digest(i, j)


def drop_repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with sentences of repeated runs taken out, and ``_n_sentences``, ``_n_removed``.

    Runs of consecutive sentences (see ``runs``) are hashed to 128 bits and joined over all documents;
    sentences covered by any repeated run but its first, by (id, position), are removed.  Null ids come
    last.  Rows with equal id and text are one document and keep the same sentences.  Null text stays null and
    empty text empty, both with no sentences; an empty table stays empty.  Other columns pass through; where
    ``df`` has a column of a result's name, that result gets another underscore.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids, hs, at, to, dig = [], [], [], [], []
                for i, h, text in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    if got := list(runs(text, run, min_words)):
                        a, b, d = zip(*got, strict=True)
                        ids += [i] * len(a)
                        hs += [h] * len(a)
                        at += a
                        to += b
                        dig += d
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(at, pa.int32()), pa.array(to, pa.int32()), pa.array(dig, pa.binary())], names=["id", "h", "i", "j", "span"])

    key = [F.coalesce(column(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(column(text_col)).alias("h")]
    key_id, key_h, found_id, found_h, at, cut_, total, removed = fresh(df, "key_id", "key_h", "found_id", "found_h", "spans", "cut", "_n_sentences", "_n_removed")
    spans = df.where(column(text_col).isNotNull()).select(*key, column(text_col).alias("text")).mapInArrow(emit, "id long, h long, i int, j int, span binary")
    spans = written(spans, "spans")
    repeated = spans.groupBy("span").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "i")).alias("first")).where("n > 1").drop("n")
    repeated = written(repeated, "repeated")  # so that a join with a hot span can be split
    again = spans.join(repeated, "span").where(F.struct("id", "h", "i") != F.col("first"))
    covered = again.groupBy(F.col("id").alias(found_id), F.col("h").alias(found_h)).agg(F.collect_set(F.struct("i", "j")).alias(at))
    joined = df.withColumns({key_id: key[0], key_h: key[1]}).join(covered, (F.col(key_id) == F.col(found_id)) & (F.col(key_h) == F.col(found_h)), "left")

    @F.pandas_udf("text string, total long, removed long")
    def cut(texts: pd.Series, at: pd.Series, to: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, at, to, strict=True):
            if text is None:
                out.append((None, 0, 0))
                continue
            pieces = sentences(text)
            if a is None:
                out.append((text, len(pieces), 0))
                continue
            gone = np.zeros(len(pieces) + 1, np.int64)
            np.add.at(gone, np.asarray(a, np.int64), 1)
            np.add.at(gone, np.asarray(b, np.int64), -1)
            gone = np.cumsum(gone[:-1]) > 0
            out.append(("".join(p for p, g in zip(pieces, gone, strict=True) if not g), len(pieces), int(gone.sum())))
        return pd.DataFrame(out, columns=["text", "total", "removed"])

    done = joined.withColumn(cut_, cut(column(text_col), F.col(at)["i"], F.col(at)["j"]))
    return done.select(*[F.col(cut_)["text"].alias(c) if c == text_col else column(c) for c in df.columns], F.col(cut_)["total"].alias(total), F.col(cut_)["removed"].alias(removed))


#: DuckDB SQL for ``drop_repeated_spans`` over documents: after the first piece every piece has a word, so a shortest run ends within 13.
SQL_CUT = r"""
WITH p AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(0, len(pieces))) AS k, len(pieces) AS total FROM (
    SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]["'')\]]*\s+|\n\s*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS pieces FROM documents WHERE text IS NOT NULL)),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(piece), '\s+'), lambda x: x <> '') AS ws FROM p),
c AS (SELECT doc_id, k, total, array_to_string(ws, ' ') AS key, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY k) AS upto, len(ws) AS n FROM w),
runs AS (SELECT a.doc_id, a.k AS i, b.k + 1 AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k + least(2, a.total) - 1 AND a.k + 13 AND b.upto - a.upto + a.n >= 12),
short AS (SELECT doc_id, i, min(j) AS j FROM runs GROUP BY doc_id, i UNION SELECT doc_id, max(i) AS i, j FROM runs GROUP BY doc_id, j),
keyed AS (SELECT short.doc_id, i, j, string_agg(key, ' ' ORDER BY k) AS span FROM short JOIN c ON c.doc_id = short.doc_id AND k >= i AND k < j GROUP BY ALL),
marked AS (SELECT doc_id, i, j, min((doc_id, i)) OVER (PARTITION BY span) <> (doc_id, i) AS again FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j)) AS k FROM marked WHERE again),
cut AS (SELECT p.doc_id, coalesce(string_agg(CASE WHEN gone.k IS NULL THEN piece END, '' ORDER BY p.k), '') AS text, count(*) AS n_sentences, count(gone.k) AS n_removed
    FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.k = gone.k GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(cut.text, '') END AS text, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN cut USING (doc_id)
"""
