"""Columns of the input that have a name the operators use themselves come back unchanged."""

import pytest

from arborlens.llm import blocks, decontaminate, lines, packing, sentences, simhash, suffixes, toxicity, warc

NAMES = ["_id", "_h", "_n", "_score", "_predicted", "main_text", "_kept", "_cut", "_found", "_spans", "_key_id", "key_id", "key_h", "key_n", "found", "found_id", "spans", "cut", "_n_sentences", "_n_removed", "_hit_keys", "hit_keys", "hit_id", "kept", "_n_lines", "_n_dropped", "id", "h", "a", "b", "fp", "n", "queue", "task", "ids", "tid", "tie", "data", "size", "item_id", "similarity", "component_id", "fingerprint", "x.y", "_SCORE_"]
SAID = ["the same old sentence is here once more. and another one follows it right away. then an end", "a text of its own with some words in it. and more of them", "the same old sentence is here once more. and another one follows it right away. then it differs", None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, SAID[k % 5], f"host{k % 2}", *[f"U{k}-{c}" for c in range(len(NAMES))]) for k in range(10)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)).repartition(3)


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(10)], "doc_id long, toxic int, _score string")
    items = spark.createDataFrame([(1, SAID[1], "x")], "item_id long, text string, doc_id string")
    return labels, items


OPERATORS = {
    "toxicity.score": lambda d, labels, items: toxicity.score(d, labels),
    "toxicity.keep_clean": lambda d, labels, items: toxicity.keep_clean(d, labels),
    "lines.drop_boilerplate": lambda d, labels, items: lines.drop_boilerplate(d, min_pages=1, ratio=0.9),
    "sentences.drop_repeated_spans": lambda d, labels, items: sentences.drop_repeated_spans(d),
    "simhash.keep_first": lambda d, labels, items: simhash.keep_first(d),
    "decontaminate.drop_contaminated": lambda d, labels, items: decontaminate.drop_contaminated(d, items),
    "blocks.main_text": lambda d, labels, items: blocks.main_text(d, "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_pass_through(docs, tables, name):
    out = OPERATORS[name](docs, *tables)
    assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert rows
    for r in rows:
        k = r[0]
        assert r[2] == f"host{k % 2}" and list(r[3 : 3 + len(NAMES)]) == [f"U{k}-{c}" for c in range(len(NAMES))]


def test_results_are_the_same_with_other_columns(spark, docs, tables):
    plain = docs.select("doc_id", "text", "source")
    for name, f in OPERATORS.items():
        a, b = f(plain, *tables), f(docs, *tables)
        cut = len(NAMES)
        assert sorted(map(str, (tuple(r) for r in a.collect()))) == sorted(str((*r[:3], *r[3 + cut :])) for r in b.collect()), name


def test_operators_with_rows_of_their_own(spark, docs, tables, tmp_path):
    plain = docs.select("doc_id", "text", "source")
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(simhash.near_duplicates(docs)) == key(simhash.near_duplicates(plain))
    assert key(suffixes.drop_repeated(docs, length=40)) == key(suffixes.drop_repeated(plain, length=40))
    assert key(decontaminate.contaminated(docs, tables[1])) == key(decontaminate.contaminated(plain, tables[1]))
    public = pytest.importorskip("public_tokenizers")
    total = lambda df: sorted((r.doc_id, r.length, r.doc_tokens) for r in df.collect())
    assert total(packing.pack(docs, public.path("word_bpe_49k.json"))) == total(packing.pack(plain, public.path("word_bpe_49k.json")))
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("source", "url").withColumnRenamed("text", "html").withColumnRenamed("found", "refers_to")
    assert warc.archive_round_trip(pages).count() == 10
