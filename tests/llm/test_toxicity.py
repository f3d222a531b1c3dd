import random
import zlib

import numpy as np

from arborlens.llm import toxicity as t

SCHEMA = "doc_id long, text string, _score string"


def model_of(text):
    c = t.codes(f"  {text} ").astype(np.int64)
    grams, n = np.unique((c[:-2] * 96 + c[1:-1]) * 96 + c[2:], return_counts=True)
    return t.CharModel(grams, n)


def brute_restore(r, noisy):
    """Every path of the lattice, by cost."""
    best = (float("inf"), "")
    options = [*t.lattice(noisy), [(" ", 0.0)]]

    def walk(k, a, b, total, out):
        nonlocal best
        if k == len(options):
            best = min(best, (total, out))
            return
        for text, price in options[k]:
            x, y, cost = a, b, total + price
            for c in text:
                c = r.code(c)
                cost += r.cost[(x * 96 + y) * 96 + c] if y or c else 0.0
                x, y = y, c
            walk(k + 1, x, y, cost, out + text)

    walk(0, 0, 0, 0.0, "")
    return best


def test_viterbi_is_exact_and_restores():
    r = t.Restorer(model_of("the idiot is a stupid moron and a loser or a pathetic clown with trash " * 20))
    for noisy in ("1d10t", "$tup1d", "i.d.i.o.t", "l0ser!", "m0r0n", "idiooot", "a$$", "p4th3tic"):
        assert r.restore(noisy).strip() == brute_restore(r, noisy)[1].strip()
    for noisy, word in (("1d10t", "idiot"), ("$tup1d,", "stupid"), ("i.d.i.o.t", "idiot"), ("IDIOOOOT", "idiot"), ("cl0wn***", "clown"), ("loser***", "loser"), ("clean", "clean")):
        assert r.words(noisy) == [word]
    assert r.words("$$$") == r.words("2024") == []
    assert "".join(t.LETTERS.findall(r.restore(t.spaced("you i d i o t there".split())[0]))) == "idiot"
    assert t.spaced("a b".split()) == []
    assert len(t.spaced(["a"] * 100_000)[0]) < 20


def test_trigrams_count_every_text(spark):
    rows = [(1, "abc é日", None), (2, None, None), (3, "", None), (4, "x" * 60_000, None)]
    got = {r.gram: r.n for r in t.trigram_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = np.zeros(96**3, int)
    for _, text, _ in rows:
        if text is not None:
            c = t.codes(f"  {text} ").astype(int)
            np.add.at(want, (c[:-2] * 96 + c[1:-1]) * 96 + c[2:], 1)
    want.reshape(96, -1)[:, 0] = 0
    assert got == {int(k): int(want[k]) for k in np.flatnonzero(want)}


def test_learns_and_holds_out(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ta", "re", "mi", "on", "el", "us"]) for _ in range(rng.randint(1, 4)))
    bad, rows, labels = ["grobnik", "zwendor", "kifplat"], [], []
    for k in range(900):
        words, y = [word() for _ in range(rng.randint(5, 60))], int(rng.random() < 0.2)
        if y:
            for _ in range(2):
                b = rng.choice(bad)
                b = rng.choice([b, b, b.replace("o", "0").replace("i", "1"), ".".join(b), " ".join(b)])
                words.insert(rng.randrange(len(words)), b)
        rows.append((k, " ".join(words), "clash"))
        labels.append((k, y, 1))
    rows += [(None, "null id", ""), (2000, None, ""), (2001, "", ""), (5, rows[5][1], "again"), (2002, "mi " * 100_000, "")]
    labels += [(None, 1, 0), (5, None, 0), (2001, 0, 0)]
    out = t.score(spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    got = out.withColumn("held", t.held_out(out.doc_id)).collect()
    assert len(got) == len(rows) and all(0 <= r._score <= 1 and r._predicted == (r._score >= 0.3) for r in got)
    truth = {a: y for a, y, _ in labels[:900]}
    held = [r for r in got if r.doc_id in truth and r.held]
    assert {r.doc_id for r in held} == {k for k in {r.doc_id for r in got} & truth.keys() if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r._predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert {r._score for r in got if r.doc_id in (2000, 2001)} == {next(r._score for r in got if r.doc_id == 2000)}


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.score(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
    assert [r._score for r in t.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), none).collect()] == [0.0]


def test_doubled_letters_and_hyphens_inside_a_word():
    model = model_of("the idiot is a stupid moron and a loser or a pathetic letter with well known book trash " * 20)
    reader = t.Reader(model, {"stupid.": 3.0, "idiot.": 2.0})
    assert reader.token("stuupid") == reader.token("stu-pid") == reader.token("STU-PIID,") == reader.token("stupid") == 3.0
    assert reader.token("letter") == reader.token("well-known") == reader.token("book") == reader.token("--") == 0.0


def test_measures_are_not_capped():
    reader = t.Reader(model_of("some plain words " * 5), {"bad.": 2.0})
    few, many = reader.measures("bad " * 30), reader.measures("bad " * 3000)
    assert many[0] > few[0] and many[1] > few[1]
