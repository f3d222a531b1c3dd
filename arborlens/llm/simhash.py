"""SimHash near-duplicates: fingerprints, a pigeonring candidate filter and exact Hamming links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh, spread, utf8, written
from .components import connected_components

SEED = 42


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of the lower-cased bytes, repeats included."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; no hashes: zero."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.unpackbits(hashes[k : k + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64)
        bits += part.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_column(text, width: int = 4):
    """The 64-bit SimHash of a text column as a long (null text: that of the empty text)."""

    @F.pandas_udf("long")
    def of(data: pd.Series) -> pd.Series:
        return pd.Series([signed(simhash(shingle_hashes(x, width))) for x in data], dtype="int64")

    return of(utf8(text))


def fingerprint_hex(col):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


class Pigeonring:
    """The ring of ``radius + 1`` bit segments.

    If two 64-bit words differ in at most ``radius`` bits, some segment starts a chain whose cumulative
    differences over j segments stay within j * radius / segments for every j (the pigeonring principle).
    With radius + 1 segments the first segment of the chain is equal and the second differs in one bit at
    most, so a key of two neighbouring segments, looked up with the second one exact or with one zero bit
    raised, meets every pair; the longer prefixes of the chain are checked on what meets.
    """

    def __init__(self, radius: int):
        if not 1 <= radius <= 15:
            raise ValueError("radius must be from 1 to 15")
        self.radius, m = radius, radius + 1
        cuts = [round(64 * k / m) for k in range(m + 1)]
        self.low, self.width = cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        self.masks = np.array([((1 << w) - 1) << a for a, w in zip(self.low, self.width, strict=True)], np.uint64)

    def segment(self, x: np.ndarray, i: int) -> np.ndarray:
        return (x >> np.uint64(self.low[i])) & np.uint64((1 << self.width[i]) - 1)

    def keys(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(keys, words, probe): the own keys of the words, and those with one zero bit raised."""
        m = len(self.low)
        for i in range(m):
            j = (i + 1) % m
            a, b = self.segment(x, i), self.segment(x, j)
            head = (np.uint64(i) << np.uint64(58)) | (a << np.uint64(self.width[j]))
            yield head | b, x, False
            for k in range(self.width[j]):
                zero = (b >> np.uint64(k)) & np.uint64(1) == 0
                yield (head | b | np.uint64(1 << k))[zero], x[zero], True

    def linked(self, x: np.ndarray, y: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs of words within the radius, after the chain from segment i; both are matched in blocks."""
        m, out = len(self.low), []
        step = max(1, (1 << 20) // max(1, len(y)))
        chain = [self.masks[[(i + d) % m for d in range(n)]].sum(dtype=np.uint64) for n in range(2, m)]
        for at in range(0, len(x), step):
            apart = x[at : at + step, None] ^ y[None, :]
            p, q = np.nonzero(np.bitwise_count(apart & chain[0]) <= 2 * self.radius // m) if chain else np.indices(apart.shape).reshape(2, -1)
            apart = apart[p, q]
            for n, mask in enumerate(chain[1:], 3):
                keep = np.bitwise_count(apart & mask) <= n * self.radius // m
                p, q, apart = p[keep], q[keep], apart[keep]
            keep = np.bitwise_count(apart) <= self.radius
            out.append((p[keep] + at, q[keep]))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for the local components of the links; linear in the nodes."""
    nodes, ids = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ids[: len(left)], ids[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def links(words: DataFrame, col: str, radius: int = 4, block: int = 8192) -> DataFrame:
    """``words``: distinct longs in ``col`` -> ``(a, b)`` longs whose closure is that of all links.

    Every pair of words within ``radius`` bits ends in one component, and every edge returned joins words
    connected by such pairs.  A bucket returns a spanning forest of its links and not its pairs.  Buckets
    over ``block`` words are cut into blocks that are matched pairwise in tasks of their own.
    """
    ring = Pigeonring(radius)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k in range(0, len(x), 2000):
                got = list(ring.keys(x[k : k + 2000]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([g[0] for g in got]).view(np.int64)),
                        pa.array(np.concatenate([g[1] for g in got]).view(np.int64)),
                        pa.array(np.concatenate([np.full(len(g[0]), g[2]) for g in got])),
                    ],
                    names=["key", "word", "probe"],
                )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(key, word, probe, part) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            sums = np.concatenate([[0], np.cumsum(~probe)])
            own = sums[hi] - sums[lo]
            left, right = [], []
            for a, b in zip(lo[(hi - lo > 1) & (own > 0)], hi[(hi - lo > 1) & (own > 0)], strict=True):
                x, other = word[a:b][~probe[a:b]], word[a:b]
                p, q = ring.linked(x, other, int(key[a]) >> 58)
                u, v = x[p], other[q]
                keep = u != v
                if keep.any():
                    u, v = _forest(u[keep].view(np.int64), v[keep].view(np.int64))
                    left.append(u)
                    right.append(v)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)]
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate(z) for z in zip(held, now, strict=True)]
            last = (now[0] == now[0][-1]) & (now[3] == now[3][-1])
            cut = len(last) - np.argmin(last[::-1]) if not last.all() else 0
            if cut:
                yield from solve(*[z[:cut] for z in now])
            held = [z[cut:] for z in now]
        if held is not None and len(held[0]):
            yield from solve(*held)

    keyed = spread(words.select(F.col(col).cast("long").alias("word")), "word").mapInArrow(emit, "key long, word long, probe boolean")
    # A hot bucket's own words are cut into n blocks by a hash and all its rows into m; block pairs are tasks of their own.
    sizes = written(words.select(F.col(col).cast("long").alias("word")).mapInArrow(_own_keys(ring), "key long").groupBy("key").count().where(F.col("count") > block // 16), "sizes")
    # What a bucket is probed with are own words of buckets with one bit less; those of small ones are under a block together.
    probed = sizes.mapInArrow(_raised(ring), "key long, count long").groupBy("key").agg(F.sum("count").alias("probes"))
    many = sizes.withColumnRenamed("count", "own").join(probed, "key", "full_outer").select("key", F.coalesce("own", F.lit(1)).alias("own"), (F.coalesce("own", F.lit(0)) + F.coalesce("probes", F.lit(0))).alias("all"))
    hot = written(many.where(F.col("all") > block).select("key", F.ceil(F.col("own") / block).cast("int").alias("n"), F.ceil(F.col("all") / block).cast("int").alias("m")), "hot")
    if not hot.isEmpty():
        n, m = F.coalesce("n", F.lit(1)), F.coalesce("m", F.lit(1))
        turn = lambda x: F.pmod(F.xxhash64("word"), x).cast("int")
        # part t * m + o holds the own words of block t of n and all words of block o of m
        as_other = F.transform(F.sequence(F.lit(0), n - 1), lambda t: (t * m + turn(m)).cast("int"))
        as_own = F.transform(F.sequence(F.lit(0), m - 1), lambda o: (turn(n) * m + o).cast("int"))
        keyed = keyed.join(hot, "key", "left").select("key", "word", "probe", F.explode(F.when(F.col("probe"), as_other).otherwise(F.array_union(as_own, as_other))).alias("part"))
    else:
        keyed = keyed.withColumn("part", F.lit(0))
    dealt = spread(keyed, "key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(match, "a long, b long")


def _own_keys(ring: Pigeonring):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for keys, _, probe in ring.keys(x):
                if not probe:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return emit


def _raised(ring: Pigeonring):
    """The buckets that a bucket's words are probed in, with its size: an upper bound of the probes from it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            count = batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(len(ring.low)):
                for k in range(ring.width[(i + 1) % len(ring.low)]):
                    here = (key >> np.uint64(58) == i) & ((key >> np.uint64(k)) & np.uint64(1) == 0)
                    yield pa.RecordBatch.from_arrays([pa.array((key[here] | np.uint64(1 << k)).view(np.int64)), pa.array(count[here])], names=["key", "count"])

    return emit


def _components(fps: DataFrame, radius: int) -> DataFrame:
    """``(fp, root)`` of every fingerprint in ``fps``; the root stands for its component."""
    words = fps.select("fp").distinct()
    found = connected_components(links(words, "fp", radius))
    return words.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``df``: ``(<id_col>, fingerprint, component_id)``.

    Texts are near duplicates if their SimHash fingerprints over ``width``-word shingles differ in at most
    ``radius`` bits; ``component_id`` is the smallest id that links reach.  Null text counts as empty;
    empty texts have fingerprint zero and link like any other.  Rows with a null id take part and get the
    smallest id of their component (null if there is none).  Repeated rows are all returned; an empty table
    gives an empty result; other columns are not read.
    """
    fps = written(df.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), width).alias("fp")), "fps")
    low = fps.groupBy("fp").agg(F.min("id").alias("id"))
    rooted = written(low.join(_components(fps, radius), "fp"), "roots")
    ids = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(ids, "fp").select(F.col("id").alias(id_col), fingerprint_hex("fp").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``df`` with one row of each component: that with the smallest id, of equal ids by a hash of the text.

    A null id comes after all others; of rows with equal id and text one stays.  Null text counts as empty and
    is near other empty texts; an empty table stays empty.  Columns are those of ``df``, whatever their names.
    """
    a, b, n = fresh(df, "key_id", "key_h", "key_n")  # the input's columns keep their names and values
    key = {a: F.coalesce(column(id_col).cast("long"), F.lit((1 << 63) - 1)), b: F.xxhash64(F.coalesce(column(text_col), F.lit("")))}
    fps = written(df.select(key[a].alias("a"), key[b].alias("b"), fingerprint_column(column(text_col), width).alias("fp")), "fps")
    low = fps.groupBy("fp").agg(F.min(F.struct("a", "b")).alias("k"))
    first = low.join(_components(fps, radius), "fp").groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.a").alias(a), F.col("k.b").alias(b))
    kept = df.withColumns(key).join(written(first, "first"), [a, b])
    once = Window.partitionBy(a, b).orderBy(F.lit(0))
    return kept.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*map(column, df.columns))
