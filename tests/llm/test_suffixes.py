import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborlens.llm import suffixes as s

SCHEMA = "doc_id long, text string, data string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(x):
    assert s.suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_long_suffix_arrays():
    rng = random.Random(1)
    for text in ("ab" * 400, "a" * 1000, "".join(rng.choices("ab", k=3000)), "abc" * 100 + "abd" * 100 + "abc" * 100):
        x = np.frombuffer(text.encode(), np.uint8)
        assert s.suffix_array(x).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(2)
    for data in (rng.randbytes(2000), b"ab" * 700, b"x" * 900, rng.randbytes(300) * 4):
        seen = {}
        at, h, first, last = s.anchors(data)
        assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
        for a, g, lo, hi in zip(at, h, first, last, strict=True):
            for p in range(lo, hi + 1):
                assert p <= a <= p + 200 - 32
                assert seen.setdefault(data[p : p + 200], (a - p, g)) == (a - p, g)
    assert len(s.anchors(b"z" * 1_300_000)[0]) == 1_300_000 - 199


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    places = defaultdict(list)
    for k, b in enumerate(texts):
        for p in range(len(b) - length + 1):
            places[b[p : p + length]].append((k, p))
    gone = [np.zeros(len(b), bool) for b in texts]
    for at in places.values():
        if len(at) > 1:
            for k, p in at:
                gone[k][p : p + length] = True
    out = []
    for (i, _), b, g in zip(rows, texts, gone, strict=True):
        edges = np.diff(np.concatenate([[0], g.view(np.int8), [0]]))
        out.append((str(i), len(b), int(g.sum()), int((edges == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~g])))
    return sorted(out)


@pytest.mark.parametrize("hot", [4000, 2])
def test_matches_brute_force(spark, hot):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choices("abcdefgh éß.\n", k=n))
    shared = [say(n) for n in (150, 199, 200, 230, 260, 420, 900)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 600), (4, "q" * 300), (5, "q" * 199), (6, say(200)), (None, say(300))]
    for k in range(90):
        text = say(rng.randint(0, 500))
        for _ in range(rng.choice([0, 1, 1, 2])):
            piece = rng.choice(shared)
            cut = rng.randint(0, 60)
            text += piece[cut:] + say(rng.randint(0, 300))
        rows.append((10 + k, text))
    rows += [(200, rows[20][1]), (201, rows[21][1] + rows[22][1]), (202, rows[23][1] + "x" + rows[23][1]), (10, rows[8][1]), (300, "a " * 3000 + shared[3])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA).repartition(4)
    got = s.drop_repeated(df, hot=hot).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows, 200)


def test_empty(spark):
    assert s.drop_repeated(spark.createDataFrame([], SCHEMA)).collect() == []
