import random

from arborlens.llm import sentences as s

SCHEMA = "doc_id long, text string, span string"


def brute(rows):
    docs = sorted({((1 << 63) - 1 if i is None else i, t) for i, t in rows if t is not None}, key=lambda r: r[0])
    first, out = {}, {}
    for i, t in docs:
        for a, b, h in s.runs(t):
            key = (i, hash(t))
            if h not in first or (i, a) < (first[h][0], first[h][2]):
                first[h] = (i, hash(t), a)
    for i, t in docs:
        gone = set()
        for a, b, h in s.runs(t):
            if (i, hash(t), a) != first[h]:
                gone |= set(range(a, b))
        out[i, t] = ("".join(p for k, p in enumerate(s.sentences(t)) if k not in gone), len(gone))
    return out


def test_pieces():
    for text in ("", "a", "A b. C d! \n\n E", "no end", "\n\n", "x.y z. ", "Ünï. 日本。 ok"):
        assert "".join(s.sentences(text)) == text


def test_matches_brute_force(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join("".join(rng.choices("abcdeß", k=4)) for _ in range(rng.randint(1, 15))).capitalize() + rng.choice([". ", "! ", ".\n", "\n"])
    shared = ["".join(sentence() for _ in range(8)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "   "), (3, "Word"), (None, "x " * 30), (4, "x " * 30), (5, "y " * 50000)]
    for k in range(60):
        text = "".join(sentence() for _ in range(rng.randint(0, 12)))
        if rng.random() < 0.5:
            text += "and so " + rng.choice(shared) + "".join(sentence() for _ in range(rng.randint(0, 4)))
        rows.append((10 + k, text))
    rows += [(200, rows[30][1]), (201, rows[31][1] * 2), (12, rows[9][1])]
    got = s.drop_repeated_spans(spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA).repartition(3)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert sum(r._n_removed for r in got) > 50
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append((r.text, r._n_removed))
    for i, t in rows:
        expect = (None, 0) if t is None else want[(1 << 63) - 1 if i is None else i, t]
        assert expect in texts[i]


def test_empty(spark):
    out = s.drop_repeated_spans(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns[:3] == ["doc_id", "text", "span"]


def every_run(text):
    """All runs of enough sentences and words, by themselves; not from ``runs``."""
    keys = [" ".join(p.lower().split()) for p in s.sentences(text)]
    sizes = [len(k.split()) for k in keys]
    need = min(s.RUN, len(keys))
    return [(a, b, " ".join(keys[a:b])) for a in range(len(keys)) for b in range(a + need, len(keys) + 1) if sum(sizes[a:b]) >= s.MIN_WORDS]


def brute_all(docs):
    """Sentences that stay of documents with ids 0, 1, ..."""
    first = {}
    for i, t in enumerate(docs):
        for a, _, k in every_run(t):
            first.setdefault(k, (i, a))
    gone = [{x for a, b, k in every_run(t) if first[k] != (i, a) for x in range(a, b)} for i, t in enumerate(docs)]
    return [("".join(p for k, p in enumerate(s.sentences(t)) if k not in g), len(g)) for t, g in zip(docs, gone, strict=True)]


def test_passage_goes_to_its_last_sentence(spark):
    words = lambda n, c: " ".join(f"{c}{k}" for k in range(n)) + ". "
    passage = words(20, "a") + words(3, "b") + words(3, "c") + words(3, "d")
    docs = [passage + words(30, "e"), words(30, "f") + passage + words(30, "g"), passage]
    got = {r.doc_id: (r.text, r._n_removed) for r in s.drop_repeated_spans(spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], SCHEMA)).collect()}
    assert got == {0: (docs[0], 0), 1: (words(30, "f") + words(30, "g"), 4), 2: ("", 4)}


def test_covers_what_all_runs_cover(spark):
    rng = random.Random(7)
    sentence = lambda: " ".join("".join(rng.choices("abcd", k=4)) for _ in range(rng.choice([1, 2, 3, 4, 11, 13]))) + rng.choice([". ", "! ", ".\n"])
    shared = ["".join(sentence() for _ in range(rng.randint(1, 9))) for _ in range(8)]
    docs = ["".join(rng.choice(shared) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(0, 6))) for _ in range(80)]
    got = {r.doc_id: (r.text, r._n_removed) for r in s.drop_repeated_spans(spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], SCHEMA).repartition(3)).collect()}
    assert got == dict(enumerate(brute_all(docs)))
