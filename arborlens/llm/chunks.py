"""Document fingerprints: content-defined chunks by a normalised gear hash, compared by weighted containment."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

LEAST, NORMAL, MOST, STRICT_BITS, LOOSE_BITS = 16, 48, 192, 7, 4
LAST = (1 << 63) - 1
#: One pseudo-random word for each byte value; the window of a 16-bit gear hash is 16 bytes.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 2024) & 0xFFFF for b in range(256)], np.uint16)


def gear(data: bytes) -> np.ndarray:
    """The gear hash after each byte, h = (h << 1) + GEAR[byte] mod 2**16, by doubling the window."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        more = h[:-k] << np.uint16(k)
        h = h.copy()
        h[k:] += more
    return h


def cuts(data: bytes) -> list[int]:
    """Chunk ends.  Before the normal size a boundary needs STRICT_BITS zero top bits, then LOOSE_BITS."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear(data)
    loose = np.flatnonzero(h < (1 << (16 - LOOSE_BITS)))
    strict = (loose[h[loose] < (1 << (16 - STRICT_BITS))] + 1).tolist()
    loose = (loose + 1).tolist()
    out, at, s, w = [], 0, 0, 0
    while n - at > LEAST:
        s = bisect_left(strict, at + LEAST, s)
        if s < len(strict) and strict[s] < at + NORMAL:
            end = strict[s]
        else:
            w = bisect_left(loose, at + NORMAL, w)
            end = loose[w] if w < len(loose) and loose[w] < at + MOST else at + MOST
        if end >= n:
            break
        out.append(end)
        at = end
    out.append(n)
    return out


def chunk_set(data: bytes) -> dict[bytes, int]:
    """Digest of each distinct chunk -> bytes it makes up, repeats included."""
    out: dict[bytes, int] = {}
    at, digest = 0, xxhash.xxh64_digest
    for end in cuts(data):
        d = digest(data[at:end])
        out[d] = out.get(d, 0) + end - at
        at = end
    return out


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Shared weight over that of the lighter set; 1 for two empty sets, 0 for one."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    if len(b) < len(a):
        a, b = b, a
    shared = sum(min(w, b[d]) for d, w in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def encoded(chunks: dict[bytes, int]) -> str:
    """Base64 of the sorted (8-byte digest, 4-byte weight) entries."""
    return base64.b64encode(b"".join(d + w.to_bytes(4, "big") for d, w in sorted(chunks.items()))).decode()


def decoded(fingerprint: str) -> dict[bytes, int]:
    raw = base64.b64decode(fingerprint)
    return {raw[k : k + 8]: int.from_bytes(raw[k + 8 : k + 12], "big") for k in range(0, len(raw), 12)}


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, fingerprint)`` of every row; null text counts as empty, whose fingerprint is empty."""

    @F.udf("string", useArrow=True)
    def of(text):
        return encoded(chunk_set((text or "").encode("utf-8", "surrogatepass")))

    return df.select(id_col, of(F.col(text_col)).alias("fingerprint"))


def neighbours(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(bucket, look, id, h, text)`` dealt and sorted so that each row's successor by descending id follows it.

    Ids are cut into ranges, and ranges of one id (or of rows without one) that hold more than their part into
    ranges of the text's hash; the first row of each range also goes, marked ``look``, to the range before it
    (of the first range, to the last), so no order over all rows is made in one task.  What the driver holds
    is a few numbers for each range.
    """
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = column(id_col).cast("long")
    rows = df.select(ids.alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    bounds = np.array(df.select(F.percentile_approx(ids, [k / n for k in range(1, n)], 10 * n)).first()[0] or [] if n > 1 else [], np.int64)
    value, times = np.unique(bounds, return_counts=True)
    edges = np.unique(np.concatenate([value, value[(times > 1) & (value < LAST)] + 1]))  # an id of several bounds has a range of its own
    splits = np.ones(len(edges) + 2, np.int64)

    def buckets(ids: pd.Series, known: pd.Series, hs: pd.Series) -> np.ndarray:
        known = known.to_numpy()
        b = len(edges) + 1 - known * np.searchsorted(edges, ids, side="right") - known
        part = (hs.to_numpy() / 2.0**64 + 0.5) * splits[b]
        return first_of[b] + np.clip(part.astype(np.int64), 0, splits[b] - 1)

    number = F.coalesce("id", F.lit(-LAST - 1))  # pandas would make floats of longs beside nulls

    def bucket_of():  # made anew after the splits have changed
        @F.pandas_udf("long")
        def of(ids: pd.Series, known: pd.Series, hs: pd.Series) -> pd.Series:
            return pd.Series(buckets(ids, known, hs))

        return of(number, F.col("id").isNotNull(), "h")

    first_of = np.cumsum(splits) - splits
    sizes = df.select(ids.alias("id"), F.lit(0).cast("long").alias("h")).withColumn("b", bucket_of()).groupBy("b").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect()
    total = sum(r.n for r in sizes)
    for r in sizes:
        if r.low == r.high:
            splits[r.b] = max(1, r.n * n // max(1, total))
    first_of = np.cumsum(splits) - splits

    firsts = rows.select("id", "h").withColumn("b", bucket_of()).groupBy("b").agg(F.max(F.struct(number, (-1 - F.col("h")).alias("h"))).alias("k")).collect()
    order = sorted((r.b, r.k[0], -1 - r.k.h) for r in firsts)
    before = {b: (order[k - 1][0], i, h) for k, (b, i, h) in enumerate(order)}

    @F.pandas_udf("array<long>")
    def targets(ids: pd.Series, known: pd.Series, hs: pd.Series) -> pd.Series:
        out = []
        for b, i, h in zip(buckets(ids, known, hs).tolist(), ids, hs, strict=True):
            to, first, fh = before[b]
            out.append([2 * b, 2 * to + 1] if h == fh and i == first else [2 * b])
        return pd.Series(out)

    dealt = rows.withColumn("code", F.explode(targets(number, F.col("id").isNotNull(), "h"))).select((F.col("code") / 2).cast("long").alias("bucket"), (F.col("code") % 2).alias("look"), "id", "h", "text")
    return dealt.repartitionById(n // 4, F.pmod("bucket", F.lit(n // 4)).cast("int")).sortWithinPartitions("bucket", "look", F.col("id").desc_nulls_last(), "h")


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and what they have in common.

    The edited text has the last half of the code points (rounded down) replaced by as many, or all, from the
    start of the next document's, by descending id and after the last the first.  Rows with equal ids follow
    each other by a hash of the text; null ids come last; one document is its own successor.  Returns
    ``(<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.
    """
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = None, [], 0
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for r in range(batch.num_rows):
                bucket, look, i, text = columns[0][r].as_py(), columns[1][r].as_py(), columns[2][r].as_py(), columns[4][r].as_py()
                chunks = None
                if held is not None and held[0] == bucket:
                    _, last, before, mine = held
                    n = len(before)
                    edited = (before[: n - n // 2] + text[: n // 2]).encode()
                    chunks, other = chunk_set(text.encode()), chunk_set(edited)
                    row = (last, n, hashlib.sha256(edited).hexdigest(), encoded(mine), encoded(other), containment(mine, other), containment(mine, chunks))
                    out.append(row)
                    size += len(row[3]) + len(row[4])
                    if len(out) >= 500 or size > 4 << 20:
                        yield made(out)
                        out, size = [], 0
                held = None if look else (bucket, i, text, chunks if chunks is not None else chunk_set(text.encode()))
        if out:
            yield made(out)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return neighbours(df, id_col, text_col).mapInArrow(run, schema)
