import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from arborlens.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, offset string"


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


HARD = ["", None, "Hello, World!", "x's don't I'LL", "a\x1cb\x85c d e", "ΑΣ Σ ΟΔΟΣ.", "H̱ İ é ,́", "<|endoftext|> <|startoftext|>", "...,,, a., 9. 9, ß. é. %. a%.", "日本語。テスト", "😀😀 👨‍👩‍👧", "\n\t ", "ſ K K"]


def test_word_cache_is_exact():
    rng = random.Random(8)
    alphabet = "abcXYZ 019.,;:!?'’%$-\n\té́̇ßΣσ日😀 ᲀ"
    texts = [t or "" for t in HARD] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)]
    model = packing.WordTokenizer(PATH)
    for _ in range(2):
        ids, ends = model.encode(pa.array([t.encode() for t in texts]))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [ids_of_fast(t) for t in texts]


@pytest.mark.parametrize("change", [lambda d: d["normalizer"]["normalizers"].pop(), lambda d: d["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"), lambda d: d["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"[\s\S]+"), lambda d: d.update(normalizer=None)])
def test_other_tokenizer_files_are_read(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    change(file)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    from tokenizers import Tokenizer

    whole, model = Tokenizer.from_file(str(path)), packing.WordTokenizer(str(path))
    texts = [t or "" for t in HARD]
    ids, ends = model.encode(pa.array([t.encode() for t in texts]))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_bytes_that_are_not_utf8():
    ids, ends = packing.WordTokenizer(PATH).encode(pa.array([b"good \xff bad", b""], pa.binary()))
    assert ids.tolist() == [*ids_of_fast("good \ufffd bad"), 2] and ends.tolist() == [len(ids) - 1, len(ids)]


_MODEL = []


def ids_of_fast(text):
    if not _MODEL:
        from tokenizers import Tokenizer

        _MODEL.append(Tokenizer.from_file(PATH))
    return [*_MODEL[0].encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("totals,shares", [([5], None), ([0, 0], None), ([1000, 1, 37, 0, 5000], None), ([900000, 120000, 40], None), ([5000, 5000], [1, 3]), ([64], None), ([4000, 7, 7], [0, 1, 1])])
def test_schedule(totals, shares):
    s = packing.Schedule(totals, shares, window=64, cycle=16)
    used = defaultdict(list)
    for q, n in enumerate(totals):
        at, seen = 0, 0
        rng = random.Random(q)
        while at < n:
            m = min(n - at, rng.randint(1, 700))
            for start, length, seq, off in s.pieces(q, at, m):
                assert start + at == seen and length > 0
                seen += length
                used[seq].append((off, length, q))
            at += m
        assert seen == n
    for seq, parts in used.items():
        at = 0
        for off, length, _ in sorted(parts):
            assert off == at
            at += length
        assert at == 64 or (at & (at - 1)) == 0
    assert sorted(used) == list(range(len(used)))
    if shares is None and len(totals) > 1 and sum(totals) > 100000:
        for seq in range(500):
            for q, n in enumerate(totals):
                mine = sum(length for _, length, p in used[seq] if p == q)
                assert abs(mine - 64 * n / sum(totals)) <= 2


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [(k, t, f"s{k % 3}", "x") for k, t in enumerate(HARD)] + [(50, "dup", None, None), (50, "dup", None, None), (None, "no id", "s0", None), (60, "long words " * 30000, "s9", "")]
    rows += [(100 + k, " ".join("".join(rng.choices("abcdé", k=4)) for _ in range(rng.randint(0, 300))), "hot", None) for k in range(60)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4), PATH).collect()
    texts = defaultdict(list)
    for i, t, _, _ in rows:
        texts[i].append(ids_of(t))
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, many in texts.items():
        ids = many[0]
        assert sum(r.length for r in by[i]) == len(many) * len(ids)
        covered = sorted((r.start, r.length) for r in by[i])
        assert covered[0][0] == 0
        for r in by[i]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for parts in sequences.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))


def test_many_sources_and_empty(spark):
    rows = [(k, "a b c", f"s{k}", None) for k in range(100)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, max_queues=8).collect()
    assert sum(r.length for r in got) == 400
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


@pytest.mark.parametrize("seed,weighted", [(0, False), (1, False), (2, True)])
def test_many_queues_hold_their_shares(seed, weighted):
    rng = random.Random(seed)
    totals = [rng.choice([0, 1, 3, 50, 700, 9000]) for _ in range(150)] + [60000]
    shares = [rng.choice([0, 1, 2, 9]) for _ in totals] if weighted else None
    s = packing.ManyQueues(totals, shares, window=256)
    used = defaultdict(list)
    for q, n in enumerate(totals):
        at = 0
        while at < n:
            m, seen = min(n - at, rng.randint(1, 700)), 0
            for start, length, seq, off in s.pieces(q, at, m):
                assert start == seen and length > 0
                seen += length
                used[seq].append((off, length, q))
            assert seen == m
            at += m
    assert sorted(used) == list(range(len(used)))
    for parts in used.values():
        at = 0
        for off, length, _ in sorted(parts):
            assert off == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    for seq in range(s.windows - 1):
        mine = defaultdict(int)
        for _, length, q in used[seq]:
            mine[q] += length
        if not weighted:
            assert all(abs(mine[q] - 256 * n / sum(totals)) <= 4 for q, n in enumerate(totals))


def test_sources_sorted_by_file_hold_their_shares(spark):
    rows = [(1000 * s + k, " ".join(["word"] * 40), f"s{s:03d}", None) for s in range(100) for k in range(9 if s else 200)]
    df = spark.createDataFrame(rows, SCHEMA).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    for shares in (None, {f"s{s:03d}": 1.0 if s else 30.0 for s in range(100)}):
        got = packing.pack(df, PATH, shares=shares, window=1024).collect()
        assert sum(r.length for r in got) == len(rows) * len(ids_of(rows[0][1]))
        mine = defaultdict(lambda: defaultdict(int))
        for r in got:
            mine[r.sequence_id][r.doc_id // 1000] += r.length
        part = {s: (200 if s == 0 else 9) if shares is None else shares[f"s{s:03d}"] for s in range(100)}
        for seq in range(5):
            assert all(abs(mine[seq][s] - 1024 * part[s] / sum(part.values())) <= 4 for s in range(100))
