import random
from collections import Counter

import numpy as np
import pytest

from arborlens.llm import decontaminate as d

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, extra int"


def brute(docs, items):
    out = set()
    for i, text in docs:
        words = d.WORDS((text or "").lower())
        for j, item in items:
            target = d.WORDS((item or "").lower())
            if not target or not words:
                continue
            n = min(len(target), len(words))
            bag = Counter(d.shingles(target))
            if any(d.similarity(Counter(d.shingles(words[k : k + n])), bag) >= 0.8 for k in range(len(words) - n + 1)):
                out.add((i, j))
    return out


@pytest.mark.parametrize("chunk", [2 << 20, 900])
def test_matches_brute_force(spark, chunk):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 8))) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([3, 5, 6, 20, 31, 50])))) for k in range(25)] + [(90, None), (91, ""), (92, "?!")]
    docs = [(0, None), (1, ""), (2, "word"), (3, items[0][1]), (3, items[0][1]), (None, items[1][1])]
    for k in range(60):
        body = say(rng.randint(0, 150))
        words = rng.choice(items[:25])[1].upper().split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            words = words[: len(words) * 3 // 4]
        at = rng.randint(0, len(body))
        docs.append((100 + k, " ".join(body[:at] + [", ".join(words)] + body[at:])))
    docs.append((500, " ".join(say(30000) + items[5][1].split() + say(5))))
    left = spark.createDataFrame([(a, b, "x") for a, b in docs], DOCS)
    right = spark.createDataFrame([(a, b, None) for a, b in items], ITEMS)
    got = d.contaminated(left, right, chunk_bytes=chunk).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    kept = d.drop_contaminated(left, right, chunk_bytes=chunk)
    assert kept.columns == left.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {r.doc_id for r in got}


def test_empty(spark):
    left = spark.createDataFrame([], DOCS)
    assert d.contaminated(left, spark.createDataFrame([], ITEMS)).collect() == []


@pytest.mark.parametrize("radius,blocks", [(19, 4), (15, 4), (24, 8), (3, 4)])
def test_block_tables_find_all_within_the_radius(radius, blocks):
    rng = np.random.default_rng(7)
    items = rng.integers(0, 1 << 63, 60, np.uint64) * np.uint64(2)
    near = items[rng.integers(0, 60, 3000)]
    for _ in range(radius):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 3000, np.uint64))
    prints = np.concatenate([near, rng.integers(0, 1 << 63, 3000, np.uint64), items])
    w, i, given = d.Blocks(items, radius, blocks).near(prints)
    apart = np.bitwise_count(prints[:, None] ^ items[None, :])
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(apart <= radius))))
    if blocks == 4:
        assert given < 0.2 * len(prints) * len(items)  # the tables prune


def test_best_window_is_reported(spark):
    item = [f"w{k}" for k in range(30)]
    text = " ".join([*item[:28], "x", "y", "z", *item, "tail", *item])
    left = spark.createDataFrame([(1, text, None)], DOCS)
    right = spark.createDataFrame([(7, " ".join(item), None)], ITEMS)
    assert [tuple(r) for r in d.contaminated(left, right).collect()] == [(1, 7, 1.0, 31, 30)]


def test_large_ids_beside_null_ids(spark):
    left = spark.createDataFrame([((1 << 60) + 1, "one two three four five six", "x"), (None, "one two three four five six", "x")], DOCS)
    right = spark.createDataFrame([(1, "one two three four five six", None)], ITEMS)
    assert {r.doc_id for r in d.contaminated(left, right).collect()} == {(1 << 60) + 1, None}


def test_long_words_count_by_weight(spark):
    """A text with under half of the item's words may hold nearly all of its weight."""
    long = "x" * 400
    right = spark.createDataFrame([(1, " ".join([long] * 5 + ["a"] * 12), None)], ITEMS)
    left = spark.createDataFrame([(1, " ".join([long] * 5 + ["a"] * 2), "x")], DOCS)
    target, words = d.WORDS(" ".join([long] * 5 + ["a"] * 12)), d.WORDS(" ".join([long] * 5 + ["a"] * 2))
    s = d.similarity(Counter(d.shingles(words)), Counter(d.shingles(target)))
    assert ([r.similarity for r in d.contaminated(left, right).collect()] == [s]) == (s >= 0.8)
