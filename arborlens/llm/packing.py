"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows."""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, tidy, utf8, written

#: CACHED, PIECES: words and pieces of words remembered; TAKEN: bytes of text encoded at once (a longer text is taken alone).
WINDOW, CYCLE, MAX_QUEUES, END_ID, CACHED, PIECES, TAKEN = 4096, 256, 64, 2, 300_000, 600_000, 4 << 20


#: Visible ASCII and letters up to U+00FF: composition leaves them as they are, and lower case is one letter for each.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+(?:\\n[!-~À-ÖØ-öø-ÿ]+)*")
PROBE = "It's 1st-rate!! x|y &&& déjà VU...\t12 (A_b)\n\nwe'll ÉTÉ ñ"


class WordTokenizer:
    """Token ids of UTF-8 texts as little-endian bytes, by a ``tokenizers`` file, through a cache of words.

    Where the file says that white space is dropped and nothing joins across it, a text's ids are those of its
    words cut at ASCII white space.  Words of plain characters are cut by the file's own pattern and their pieces
    go to the merge model; others go through the whole tokenizer.  So do whole texts that hold a special token's
    string, and all texts if the file is of another kind or a probe text comes out differently.
    """

    def __init__(self, path: str, end_id: int | None = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.known_pieces: dict[str, bytes] = {"\n": b""}
        self.end = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        self.tokenize = self.model.model.tokenize
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in plain]
        self.byte_marks = [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]
        self.raw = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.model.get_vocab_size(with_added_tokens=True))]
        with open(path, encoding="utf-8") as f:
            self.pieces = self._pattern(json.load(f))
        if self.pieces and b"".join(self._encode_words(PROBE.split())) != self._whole([PROBE])[0]:
            self.pieces = None

    @staticmethod
    def _pattern(file: dict):
        """``findall`` of the pattern that cuts lower-cased words, if the file's steps are those described; else None."""
        import regex

        before, cut = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
        steps = [(x.get("type"), (x.get("pattern") or {}).get("Regex"), x.get("content")) for x in before.get("normalizers", [])]
        cuts = cut.get("pretokenizers", [])
        if steps != [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"]:
            return None
        split, level = cuts
        if (split["behavior"], split["invert"]) != ("Removed", True) or level["add_prefix_space"] or level["use_regex"] or file["model"]["type"] != "BPE" or file["model"].get("dropout"):
            return None
        pattern = regex.compile(split["pattern"].get("Regex", "()") + r"|\n")
        return None if pattern.groups else pattern.findall

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.model.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, self.kind).tobytes() for e in got]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all UTF-8 texts, without nulls, one after another, each with the end id; where each text ends)."""
        try:
            texts = texts.cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
        alone = np.full(len(texts), self.pieces is None)
        for s in self.special:
            alone |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(alone).tolist()
        own = [np.frombuffer(x, self.kind) for x in self._whole(texts.take(pa.array(whole, pa.int64())).to_pylist())]
        words = pc.ascii_split_whitespace(pc.if_else(pa.array(alone), "", texts) if whole else texts)
        table = words.flatten().dictionary_encode()
        got = self._ids_of(table.dictionary.to_pylist())
        flat, sizes, codes = np.frombuffer(b"".join(got), self.kind), np.fromiter(map(len, got), np.int64, len(got)) // self.kind.itemsize, table.indices.to_numpy()
        first = np.cumsum(sizes) - sizes
        many = sizes[codes]
        ends = np.cumsum(many)
        at = np.repeat(first[codes] - (ends - many), many)
        at += np.arange(len(at))
        ids = flat[at]
        cuts = np.concatenate([[0], ends])[words.offsets.to_numpy()[1:]]
        if whole:
            parts = np.split(ids, cuts[:-1])
            for k, x in zip(whole, own, strict=True):
                parts[k] = x
            ids, cuts = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        if self.end:
            ids = np.insert(ids, cuts, np.frombuffer(self.end, self.kind)[0])
            cuts = cuts + np.arange(1, len(cuts) + 1)
        return ids, cuts

    def _ids_of(self, words: list[str]) -> list[bytes]:
        known = self.words
        got = list(map(known.get, words))
        if holes := [k for k, ids in enumerate(got) if ids is None]:
            missing = [words[k] for k in holes]
            extra = self._encode_words(missing)
            for k, ids in zip(holes, extra, strict=True):
                got[k] = ids
            room = max(0, CACHED - len(known))
            known.update(zip(missing[:room], extra[:room], strict=True))
        return got

    def _encode_words(self, words: list[str]) -> list[bytes]:
        text = "\n".join(words)
        if not PLAIN.fullmatch(text):
            plain, out = PLAIN.fullmatch, [b""] * len(words)
            mine = [k for k, w in enumerate(words) if plain(w)]
            rest = [k for k, w in enumerate(words) if w and not plain(w)]
            for k, ids in [*zip(mine, self._encode_words([words[k] for k in mine]) if mine else [], strict=True), *zip(rest, self._whole([words[k] for k in rest]), strict=True)]:
                out[k] = ids
            return out
        pieces = self.pieces(text.lower())
        got = list(map(self.known_pieces.get, pieces))
        for k in [k for k, ids in enumerate(got) if ids is None]:
            got[k] = self.known_pieces.get(pieces[k]) or self._piece(pieces[k])
        ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        cuts = ends[[k for k, p in enumerate(pieces) if p == "\n"]].tolist()
        raw = b"".join(got)
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]

    def _piece(self, piece: str) -> bytes:
        raw = self.raw
        marked = piece if piece.isascii() else "".join([self.byte_marks[b] for b in piece.encode()])
        ids = b"".join([raw[t.id] for t in self.tokenize(marked)])
        if len(self.known_pieces) < PIECES:
            self.known_pieces[piece] = ids
        return ids


_TOKENIZERS: dict = {}


def tokenizer(path: str, end_id: int | None, run: str = "") -> WordTokenizer:
    """One for each Python worker and run, which keeps its cache between the run's tasks and no longer."""
    if (path, end_id, run) not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[path, end_id, run] = WordTokenizer(path, end_id)
    return _TOKENIZERS[path, end_id, run]


class Schedule:
    """Which window takes which tokens of each queue.

    Deficit round-robin: every window adds each queue's quantum to its deficit, the queue sends as many
    tokens as its deficit holds, and what rounding leaves goes to the largest deficits; what a queue could
    not send is carried to later windows.  Quanta are whole over a cycle of windows, so the deficits return
    to where they were and a run of cycles is stored as one segment; windows near the end of a queue are
    stored one by one, and the queues that are left share on.  Its size depends on the number of queues
    and not on the data.  A segment is (first window, cycles, windows a cycle, per-window cumulative takes
    [windows + 1, queues]); ``starts`` holds each queue's tokens sent before the segment.
    """

    def __init__(self, totals: list[int], shares: list[float] | None = None, window: int = WINDOW, cycle: int = CYCLE):
        left, at = np.array(totals, np.int64), 0
        target = np.array(totals if shares is None else shares, np.float64)
        self.window, self.total, self.segments, starts = window, int(left.sum()), [], []
        sent = np.zeros(len(left), np.int64)

        def add(cycles: int, table: np.ndarray) -> None:
            nonlocal left, sent, at
            self.segments.append((at, cycles, len(table) - 1, table, np.cumsum(np.diff(table, axis=0), axis=1) - np.diff(table, axis=0)))
            starts.append(sent.copy())
            sent, left, at = sent + table[-1] * cycles, left - table[-1] * cycles, at + cycles * (len(table) - 1)

        while left.sum() > 0:
            open_ = left > 0
            p = np.where(open_, np.maximum(target, 1e-12), 0.0)
            if left.sum() <= window:
                add(1, np.stack([np.zeros_like(left), left]))
                break
            quanta = self._whole(p / p.sum() * window * cycle, window * cycle, open_)
            table = self._cycle(quanta, window, cycle)
            cycles = int((left[quanta > 0] // quanta[quanta > 0]).min())
            if cycles:
                add(cycles, table)
                continue
            for k in range(cycle):  # until a queue runs out
                take = table[k + 1] - table[k]
                short = take > left
                take = np.minimum(take, left)
                if (gap := int(min(window, left.sum()) - take.sum())) > 0:
                    spare = left - take
                    while gap > 0:
                        q = np.where(spare > 0, p, 0.0)
                        if q.sum() == 0:
                            q = (spare > 0).astype(float)
                        more = np.minimum(self._whole(q / q.sum() * gap, gap, q > 0), spare)
                        take, spare, gap = take + more, spare - more, gap - int(more.sum())
                add(1, np.stack([np.zeros_like(take), take]))
                if short.any() or left.sum() <= window or (open_ & (left == 0)).any():
                    break
        self.starts = np.array(starts, np.int64).reshape(len(starts), len(totals))
        self.windows = at
        #: The last window's tokens are cut into powers of two, which need no padding.
        rest = self.total - (at - 1) * window if at else 0
        self.tail = [window] if rest == window else [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]

    @staticmethod
    def _whole(x: np.ndarray, total: int, open_: np.ndarray) -> np.ndarray:
        """Whole numbers near x that add up to total; largest remainders first."""
        out = np.floor(x).astype(np.int64)
        order = np.argsort(-(x - out) + np.where(open_, 0, 9), kind="stable")
        out[order[: total - int(out.sum())]] += 1
        return out

    @staticmethod
    def _cycle(quanta: np.ndarray, window: int, cycle: int) -> np.ndarray:
        deficit, table = np.zeros(len(quanta), np.int64), [np.zeros(len(quanta), np.int64)]
        for _ in range(cycle):
            deficit = deficit + quanta  # in parts of 1 / cycle token
            take = np.maximum(deficit // cycle, 0)
            rest = deficit - take * cycle
            need = window - int(take.sum())
            if need > 0:
                take[np.argsort(-rest, kind="stable")[:need]] += 1
            while need < 0:
                k = int(np.argmin(np.where(take > 0, rest, 1 << 60)))
                take[k], need, rest[k] = take[k] - 1, need + 1, rest[k] + cycle
            deficit = deficit - take * cycle
            table.append(table[-1] + take)
        assert (table[-1] == quanta).all()
        return np.stack(table)

    def pieces(self, queue: int, first: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the n tokens of a queue from ``first`` on."""
        done = 0
        while done < n:
            x = first + done
            k = int(np.searchsorted(self.starts[:, queue], x, side="right")) - 1
            w0, cycles, _, table, before = self.segments[k]
            column = table[:, queue]
            lap, y = divmod(x - int(self.starts[k, queue]), int(column[-1]))
            j = int(np.searchsorted(column, y, side="right")) - 1
            length = min(int(column[j + 1]) - y, n - done)
            w, offset = w0 + lap * (len(table) - 1) + j, int(before[j, queue]) + y - int(column[j])
            if w < self.windows - 1:
                yield done, length, w, offset
            else:
                yield from self._last(done, length, w, offset)
            done += length

    def _last(self, start: int, length: int, w: int, offset: int) -> Iterator[tuple[int, int, int, int]]:
        at = 0
        for k, size in enumerate(self.tail):
            a, b = max(offset, at), min(offset + length, at + size)
            if a < b:
                yield start + a - offset, b - a, w + k, a - at
            at += size


class ManyQueues(Schedule):
    """The same for any number of queues, as a closed form whose size is the number of queues.

    The stream of all tokens is a run of phases in which the shares stay; a phase ends when a queue runs out, so
    with the default shares there is one.  In a phase, the queues are halved by weight again and again, and at
    each halving the first x tokens hold round(x * left / all) of the left half: a count that never falls, and
    any window is within a few tokens of its shares.  Custom shares that let queues run out one after another
    make a phase, and a row of sums, for each.
    """

    def __init__(self, totals: list[int], shares: list[float] | None = None, window: int = WINDOW):
        whole = np.array(totals, np.int64)
        self.window, self.total = window, int(whole.sum())
        self.windows = -(-self.total // window)
        rest = self.total - (self.windows - 1) * window if self.windows else 0
        self.tail = [window] if rest == window else [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        done, self.bases, self.sent, self.sums, self.paths = np.zeros_like(whole), [], [], [], {}
        weight = None if shares is None else np.maximum(np.array(shares, np.float64), 1e-12)
        for end in [np.inf] if weight is None else np.unique(whole / weight).tolist():
            upto = whole if weight is None else np.where(whole / weight <= end, whole, np.maximum(np.minimum(weight * end, whole).astype(np.int64), done))
            if (upto > done).any():
                self.bases.append(int(done.sum()))
                self.sent.append(np.concatenate([[0], np.cumsum(done)]))
                self.sums.append(np.concatenate([[0], np.cumsum(upto - done)]))
                done = upto

    def _path(self, phase: int, queue: int) -> list[tuple[int, int, bool]]:
        """(tokens of the left half, tokens, whether the queue is in the right half) of each halving."""
        if (phase, queue) not in self.paths:
            sums, path, a = self.sums[phase], [], 0
            b = len(sums) - 1
            while b - a > 1:
                low, high = int(sums[a]), int(sums[b])
                m = int(np.searchsorted(sums, (low + high) // 2))
                m = min(max(m, a + 1), b - 1)
                path.append((int(sums[m]) - low, high - low, queue >= m))
                a, b = (m, b) if queue >= m else (a, m)
            self.paths[phase, queue] = path
        return self.paths[phase, queue]

    def counts(self, queue: int, x: int) -> tuple[int, int]:
        """Tokens of the queues before this one, and of this one, among the first x of the stream."""
        k = bisect.bisect_right(self.bases, min(x, self.total - 1)) - 1
        before, own, x = int(self.sent[k][queue]), int(self.sent[k][queue + 1] - self.sent[k][queue]), min(x, self.total) - self.bases[k]
        for left, both, right in self._path(k, queue):
            mine = (x * left + both // 2) // both if both else 0
            before, x = (before + mine, x - mine) if right else (before, mine)
        return before, own + x

    def pieces(self, queue: int, first: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        done, w = 0, 0
        upto = lambda w: self.counts(queue, w * self.window)[1]
        while done < n:
            x, step = first + done, 1
            while w + step < self.windows and upto(w + step) <= x:
                w, step = w + step, step * 2
            end = min(w + step, self.windows)
            while end - w > 1:
                mid = (w + end) // 2
                w, end = (mid, end) if upto(mid) <= x else (w, mid)
            (b0, c0), (b1, c1) = self.counts(queue, w * self.window), self.counts(queue, (w + 1) * self.window)
            length, offset = min(c1 - x, n - done), b1 - b0 + x - c0
            if w < self.windows - 1:
                yield done, length, w, offset
            else:
                yield from self._last(done, length, w, offset)
            done += length


def _queues(df: DataFrame, source_col: str, max_queues: int):
    """Queue of a source, and the sources in order if there are more than ``max_queues``: those are numbered by task."""
    sources = df.select(F.col(source_col).cast("string")).distinct()
    names = [r[0] for r in sources.limit(max_queues + 1).collect()]
    if len(names) > max_queues:
        names = sorted((r[0] for r in sources.collect()), key=lambda x: (x is not None, x or ""))
        return F.col(source_col).cast("string"), len(names), names
    names.sort(key=lambda x: (x is not None, x))
    out = F.lit(0)
    for k, name in enumerate(names):
        if name is not None:
            out = F.when(F.col(source_col).cast("string") == name, k).otherwise(out)
    return out.cast("int"), max(1, len(names)), None


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shares: dict | None = None, window: int = WINDOW, end_id: int | None = END_ID, cycle: int = CYCLE, max_queues: int = MAX_QUEUES) -> DataFrame:
    """``(<id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: one row per piece.

    Every text's ids and ``end_id`` join the queue of its source; each window of ``window`` tokens takes from
    every queue its share (by default the source's share of all tokens; ``shares`` maps sources to weights),
    see ``Schedule``.  Texts are cut where windows end; the last window is cut into powers of two, so there
    is no padding.  Null texts are empty and have ``end_id`` alone; null sources have a queue of their own;
    repeated rows are packed each.  Over ``max_queues`` sources have a queue each too, see ``ManyQueues``;
    their names and sums are on the driver.  Ids are written once to the shared folder with their place in the queue within the writing
    task; the queue's places follow from one sum for each task and queue.
    """
    spark = df.sparkSession
    queue, n, many = _queues(df, source_col, max_queues)
    number = None if many is None else spark.sparkContext.broadcast({name: k for k, name in enumerate(many)})
    kind = df.schema[id_col].dataType

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task, at = tokenizer(tokenizer_path, end_id, path), TaskContext.get().partitionId(), [0] * n
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
            k = 0
            while k < batch.num_rows:
                end = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + TAKEN, side="right")))
                part = batch.slice(k, end - k)
                ids, cuts = model.encode(part.column(2))
                queues, first, lengths = part.column(1).to_pylist(), [], np.diff(cuts, prepend=0)
                if number is not None:
                    queues = [number.value[q] for q in queues]
                for q, x in zip(queues, lengths.tolist(), strict=True):
                    first.append(at[q])
                    at[q] += x
                places = pa.array(np.concatenate([[0], cuts]) * model.kind.itemsize, pa.int64())
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, places.buffers()[1], pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(queues, pa.int32()), pa.array([task] * part.num_rows, pa.int32()), pa.array(first, pa.int64()), pa.array(lengths, pa.int64()), data], names=["id", "queue", "task", "first", "n", "ids"])
                k = end

    path = new_path(spark, "ids")
    fields = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("queue int, task int, first long, n long, ids binary").fields])
    df.select(F.col(id_col).alias("id"), queue.alias("queue"), utf8(F.col(text_col)).alias("text")).mapInArrow(tidy(tokens, collect=False), fields).write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(fields).parquet(path)
    sums = kept.groupBy("task", "queue").agg(F.sum("n").alias("n"))
    totals = {r.queue: r.n for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    weights = None
    if shares is not None:
        names = dict(enumerate(many)) if many is not None else {r.queue: r.s for r in df.select(queue.alias("queue"), F.col(source_col).cast("string").alias("s")).distinct().collect()}
        weights = [float(shares.get(names.get(q), 0.0)) for q in range(n)]
    sizes = [totals.get(q, 0) for q in range(n)]
    plan = spark.sparkContext.broadcast(Schedule(sizes, weights, window, cycle) if many is None else ManyQueues(sizes, weights, window))
    # Written first, so that its size is known when the join is planned: a small one leaves the ids where they are.
    bases = written(sums.selectExpr("task", "queue", "sum(n) OVER (PARTITION BY queue ORDER BY task) - n AS base"), "bases")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, size = plan.value, 2 if small else 4
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                index, out = [], []
                for r, (q, first, m, raw) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True)):
                    words = np.frombuffer(raw, f"<u{size}").astype("<u4").tobytes()
                    for start, length, sequence, offset in schedule.pieces(q, first, m):
                        index.append(r)
                        out.append((start, length, zlib.crc32(words[4 * start : 4 * (start + length)]), m, sequence, offset))
                if out:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index, pa.int32())), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    small = tokenizer(tokenizer_path, end_id).kind.itemsize == 2
    done = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").fields])
    return kept.join(bases, ["task", "queue"]).select("id", "queue", (F.col("base") + F.col("first")).alias("at"), "n", "ids").mapInArrow(tidy(cut, collect=False), done)
