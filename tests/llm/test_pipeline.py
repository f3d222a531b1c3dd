import random
from collections import Counter

import pytest


corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus(tmp_path, spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ren", "tus", "ar"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, line(25)) for k in range(5)]
    docs, labels = [], []
    for k in range(400):
        text = "\n".join(line(rng.randint(8, 25)) for _ in range(rng.randint(2, 5)))
        y = int(rng.random() < 0.2)
        if y:
            text += " grobnik " + line(3) + " zwendor grobnik"
        if k % 4 == 0:
            text = "Menu home about\n" + text
        if k % 41 == 0:
            text += " " + items[k % 5][1]
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, 1, y))
    docs += [(1000 + k, docs[k][1], "en", "s0", docs[k][4]) for k in range(10)]
    docs += [(2000, None, None, None, None), (2001, "", "", "", 0)]
    frames = {"documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return docs, items, dict((a, y) for a, _, y in labels)


def test_stages_take_effect(spark, tmp_path):
    docs, items, toxic = corpus(tmp_path, spark)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        if name != "packing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            path = f"{tmp_path}/{name}-out"
            frame.write.parquet(path)
            frame = spark.read.parquet(path)
        seen.append([r.asDict() for r in frame.collect()])
    one, two, three, four, five = seen
    wrong = [r["doc_id"] for r in one if toxic.get(r["doc_id"])] + [i for i, y in toxic.items() if not y and i not in {r["doc_id"] for r in one}]
    assert len(wrong) < 8
    assert not any("Menu home about" in (r["text"] or "") for r in two) and len(two) == len(one)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in two)
    ids = {r["doc_id"] for r in three}
    assert not ids & set(range(1000, 1010)) and len(ids) == len(three)
    leaks = {r["doc_id"] for r in three if any(item in (r["text"] or "") for _, item in items)}
    assert leaks and {r["doc_id"] for r in four} == ids - leaks
    assert {r["doc_id"] for r in five} == {r["doc_id"] for r in four}
    assert sum(Counter(r["doc_id"] for r in five).values()) >= len(four)
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"], r["start"])
    assert {key(r): r["doc_tokens"] for r in five}.keys() >= {(r["doc_id"], 0) for r in four}
    assert sum(r["length"] for r in five) == sum(r["length"] for r in run)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
