import random
from collections import defaultdict

from arborlens.llm import lines

SCHEMA = "doc_id long, text string, source string, line string, n long"


def brute(rows, ratio, least):
    pages = defaultdict(set)
    for _, t, s, *_ in rows:
        if t is not None:
            pages[s].add(t)
    bad = set()
    for s, texts in pages.items():
        count = defaultdict(int)
        for t in texts:
            for x in {x.strip(" ") for x in t.split("\n")} - {""}:
                count[x] += 1
        bad |= {(s, x) for x, n in count.items() if n >= least and n > len(texts) * ratio}
    out = []
    for i, t, s, *_ in rows:
        if t is None:
            out.append((str(i), None, 0, 0))
            continue
        every = t.split("\n")
        kept = [x for x in every if (s, x.strip(" ")) not in bad]
        out.append((str(i), "\n".join(kept), len(every), len(every) - len(kept)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(7)
    say = lambda: " ".join("".join(rng.choices("abcé", k=3)) for _ in range(4))
    common = [say() for _ in range(6)]
    rows = []
    for k in range(300):
        body = [say() for _ in range(rng.randint(0, 6))]
        for j, c in enumerate(common):
            if rng.random() < 0.25 / (j + 1):
                body.insert(rng.randint(0, len(body)), rng.choice([c, f"  {c} "]))
        rows.append((k, "\n".join(body), rng.choice(["hot", "hot", "b", "tiny", None]) if k < 290 else f"one{k}", "x", 1))
    rows += [(5, rows[5][1], rows[5][2], None, None), (None, rows[7][1], "hot", None, None), (900, None, "hot", None, None), (901, "", "b", None, None), (902, "\n\n", "b", None, None)]
    rows += [(1000 + k, "copied line\nsame page", "hot", None, None) for k in range(60)]
    rows += [(2000, "\n".join(common * 5000), "hot", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = lines.drop_boilerplate(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"]
    got = sorted(((str(r.doc_id), r.text, r._n_lines, r._n_dropped) for r in out.collect()), key=str)
    assert got == brute(rows, lines.RATIO, lines.MIN_PAGES)
    assert sum(g[3] for g in got) > 100


def test_empty(spark):
    assert lines.drop_boilerplate(spark.createDataFrame([], SCHEMA)).collect() == []
