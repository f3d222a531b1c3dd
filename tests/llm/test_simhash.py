import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arborlens.llm.components import connected_components
from arborlens.llm.simhash import Pigeonring, keep_first, links, near_duplicates

SCHEMA = "doc_id long, text string, word string"


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeÉß", k=rng.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(40)]
    out = list(base) + [None, "", " \t\n", "One", "one", base[0].upper(), base[1]] + ["x " * 20000]
    for b in base[:25]:
        for _ in range(3):
            w = b.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return out


def test_matches_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(3, "again", None), (None, None, None)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    comp = closure(pairs, range(len(rows)))
    low = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            low[comp[i]] = min(low.get(comp[i], d), d)
    want = sorted((str(d), f"{fps[i]:016x}", low[comp[i]]) for i, (d, _, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("block", [8192, 7])
@pytest.mark.parametrize("radius", [1, 3, 4])
def test_links_keep_every_component(spark, block, radius):
    rng = random.Random(radius)
    words = {rng.getrandbits(64) for _ in range(30)}
    for w in list(words):
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                w ^= 1 << b
            words.add(w)
    words = sorted(w - (1 << 64) if w >> 63 else w for w in words)
    df = spark.createDataFrame([(w,) for w in words], "fp long")
    got = closure([tuple(r) for r in links(df, "fp", radius, block).collect()], words)
    mask = (1 << 64) - 1
    assert got == closure([(a, b) for a in words for b in words if a < b and bin((a ^ b) & mask).count("1") <= radius], words)


def test_keep_first(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(3, "again", None), (None, None, None), (4, texts()[4], "x"), (None, "unlike any other text here", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = keep_first(df)
    assert got.columns == df.columns
    kept = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    low = {}
    for r in near_duplicates(spark.createDataFrame([(k, t, None) for k, (_, t, _) in enumerate(rows)], SCHEMA)).collect():
        low.setdefault(r.component_id, []).append(rows[r.doc_id])
    assert len(kept) == len(low)
    for group in low.values():
        least = min((1 << 63) - 1 if i is None else i for i, _, _ in group)
        assert any((str(i), t or "") in kept for i, t, _ in group if ((1 << 63) - 1 if i is None else i) == least)


def test_empty(spark):
    assert keep_first(spark.createDataFrame([], SCHEMA)).collect() == []
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7), (200, 100), (100, 200)]
    df = spark.createDataFrame(edges, "a long, b long").where(F.lit(True))
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90, 200: 90}


def test_written_tables_can_be_removed(spark):
    from arborlens.llm import common

    df = common.written(spark.createDataFrame([(1,)], "x long"), "test")
    assert df.collect()[0].x == 1 and df.inputFiles()
    common.remove_written(spark)
    assert common._MADE == []


def test_bucket_probed_by_many_words_is_cut(spark):
    """Few own words beside a hot bucket: the hot one's probes are cut into blocks too, and no link is lost."""
    ring = Pigeonring(4)
    rng = np.random.default_rng(5)
    high = np.uint64(1) << np.uint64(30)
    hot = np.unique((rng.integers(0, 1 << 20, 3000, np.uint64) << np.uint64(44)))  # equal low segments: one bucket of own words
    near = hot[:40] | np.uint64(1 << (ring.low[1]))  # the bucket with one bit more
    words = np.unique(np.concatenate([hot, near, rng.integers(0, 1 << 62, 200, np.uint64) | high])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in words], "w long")
    roots = {}
    for block in (8192, 100):
        found = connected_components(links(df, "w", block=block)).collect()
        roots[block] = {r.node: r.component for r in found}
    assert roots[8192] == roots[100] and len(roots[100]) > 40
    u = words.view(np.uint64)
    apart = np.bitwise_count(u[:, None] ^ u[None, :])
    for a, b in zip(*np.nonzero((apart <= 4) & (apart > 0))):
        assert roots[100][int(words[a])] == roots[100][int(words[b])]
    assert all(int(words[k]) in roots[100] for k in np.flatnonzero(((apart <= 4) & (apart > 0)).any(axis=1)))
