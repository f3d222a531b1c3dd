import hashlib
import random

from arborlens.llm import chunks

SCHEMA = "doc_id long, text string, fingerprint string"


def slow_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFF
        out.append(h)
    return out


def test_gear_and_cuts():
    rng = random.Random(1)
    for n in (0, 1, 5, 16, 17, 40, 500, 5000):
        data = rng.randbytes(n)
        assert chunks.gear(data).tolist() == slow_gear(data) if n else True
        ends = chunks.cuts(data)
        assert (ends[-1] if ends else 0) == n
        sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        assert all(chunks.LEAST <= s <= chunks.MOST for s in sizes[:-1])


def test_shift_resistant():
    data = random.Random(2).randbytes(20000)
    assert chunks.containment(chunks.chunk_set(data), chunks.chunk_set(b"some words before " + data)) > 0.95
    assert chunks.containment(chunks.chunk_set(data), chunks.chunk_set(random.Random(3).randbytes(20000))) == 0
    s = chunks.chunk_set(data)
    assert chunks.decoded(chunks.encoded(s)) == s


def test_query_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcé😀 ", k=rng.randint(1, 7)))
    rows = [(rng.randint(-200, 400), " ".join(word() for _ in range(rng.randint(0, 90))), "x") for _ in range(150)]
    rows = list({r[0]: r for r in rows}.values()) + [(1000, None, None), (1001, "", ""), (1002, "z" * 300000, None), (1003, "same", ""), (1004, "same", "")]
    got = {r.doc_id: r for r in chunks.edited_likeness(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, text, _) in enumerate(order):
        a, b = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(a)
        e = a[: n - n // 2] + b[: n // 2]
        r = got[i]
        sets = [chunks.chunk_set(t.encode()) for t in (a, e, b)]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (chunks.encoded(sets[0]), chunks.encoded(sets[1]))
        assert (r.near_edited, r.near_next) == (chunks.containment(sets[0], sets[1]), chunks.containment(sets[0], sets[2]))
    assert got[1003].fingerprint == got[1004].fingerprint


def test_small_and_null(spark):
    one = chunks.edited_likeness(spark.createDataFrame([(7, "abcd", "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert chunks.edited_likeness(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "first", ""), (None, "second", ""), (3, "third", ""), (3, "third", "")]
    assert len(chunks.edited_likeness(spark.createDataFrame(rows, SCHEMA)).collect()) == 4
    assert len(chunks.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()) == 4


def test_hot_and_missing_ids(spark):
    """A third of the rows without an id and a third with one id: ranges of the hash; rows follow each other by id, then hash."""
    rng = random.Random(11)
    text = lambda: "".join(rng.choices("abcdef ", k=rng.randint(0, 60)))
    rows = [(None, text(), "") for _ in range(300)] + [(7, text(), "") for _ in range(300)] + [(k, text(), "") for k in range(300)] + [((1 << 63) - 1, "last", ""), (-(1 << 63), "least", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    dealt = chunks.neighbours(df, "doc_id", "text").collect()
    sizes = {}
    for r in dealt:
        sizes[r.bucket] = sizes.get(r.bucket, 0) + 1
    assert max(sizes.values()) < 120 and sum(r.look == 0 for r in dealt) == len(rows)
    hashed = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = sorted(hashlib.sha256((a.text[: len(a.text) - len(a.text) // 2] + b.text[: len(a.text) // 2]).encode()).hexdigest() for a, b in zip(order, [*order[1:], order[0]], strict=True))
    assert sorted(r.edited_sha256 for r in chunks.edited_likeness(df).collect()) == want
