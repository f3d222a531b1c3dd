import time

import numpy as np

from arborlens.llm import block_training as t
from arborlens.llm import blocks as b


def cut(page):
    return [x[0] for x in b.Parser().blocks(page)]


def test_blocks():
    page = """<!DOCTYPE html><head><title>no</title><style>p{}</style><script>var t="</p><p>x";</script></head>
    <body><!-- ad <p>no</p> --><nav><ul><li><a href="/x">One</a><li>Two</ul></nav><p>A &amp; B&nbsp; c<br>d <b>bold</b>
    <p title="a>b">Next<div>In <i>div</i></div>loose &lt;text&gt;<textarea>raw <p></textarea></p>&copy; end<p>"""
    assert cut(page) == ["One", "Two", "A & B c d bold", "Next", "In div", "loose <text>", "© end"]
    assert cut("") == cut("   ") == cut("<p></p>") == cut("<script>never closed") == []
    assert cut("plain") == ["plain"] and cut("a < b") == ["a < b"] and cut("<p>x</span></p></div>y") == ["x", "y"]
    assert cut('<p class="x>lost') == ['<p class="x>lost'] or cut('<p class="x>lost') == ["lost"]
    deep = b.Parser().blocks("<div>" * 5000 + "x" + "</div>" * 5000)
    assert deep[0][0] == "x" and len(deep[0][1]) == 5000
    assert len(cut("<p>" + "word " * 200_000)[0]) == 999_999
    path = b.Parser().blocks('<div id=main class="Post entryContent"><p>x')[0][1]
    assert tuple(path) == tuple(b.bucket(k, n, b.TAGS) for k, n in (("tag", "div"), ("name", "main"), ("name", "post"), ("name", "entry"), ("name", "content"), ("tag", "p")))


def test_gradients():
    made = t.Pages(3)
    data = t.labelled([made.page() for _ in range(3)])
    pages, ys = zip(*data, strict=True)
    model = b.Labeller({k: v.astype(np.float64) for k, v in t.initial(1).items()})
    _, g = t.gradients(model, pages, ys)
    rng = np.random.default_rng(0)
    for name in model.w:
        at = np.unravel_index(np.argmax(np.abs(g[name])) if rng.random() < 0.7 else rng.integers(g[name].size), g[name].shape)
        kept, e = model.w[name][at], 1e-2
        model.w[name][at] = kept + e
        up, _ = t.gradients(model, pages, ys)
        model.w[name][at] = kept - e
        down, _ = t.gradients(model, pages, ys)
        model.w[name][at] = kept
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-3 * max(1, abs(g[name][at]) * 20), name


def test_training_learns():
    made = t.Pages(11)
    model = b.Labeller(t.train(n_pages=400, epochs=8, batch=16))
    assert t.accuracy(model, [made.page() for _ in range(40)]) > 0.9


def test_kept_weights_on_held_out_pages():
    made = t.Pages(1234)
    assert t.accuracy(b.Labeller(), [made.page() for _ in range(200)]) > 0.99


PAGE = """<html><body><header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>
<div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div>
<article><h1>The title of it</h1><p>First paragraph of   the text, which is rather long and goes on.</p><div class="ad">Buy now!</div><p>Second &amp; last. All rights reserved.</p></article>
<aside class="sidebar"><h3>Recent</h3><ul><li><a href=/a>One post</a></li></ul></aside>
<section id="comments"><div class="comment"><p>I think that this is a long reader comment about the text.</p></div><form><label>Name</label></form></section>
<footer>&copy; 2024 Site</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (1, PAGE, "y"), (None, "<p>", None)]
    out = b.main_text(spark.createDataFrame(rows, "page_id long, html string, text string"))
    got = out.collect()
    want = "The title of it\nFirst paragraph of the text, which is rather long and goes on.\nSecond & last. All rights reserved."
    assert out.columns == ["page_id", "html", "text", "main_text"]
    assert sorted((str(r.page_id), r.main_text) for r in got) == sorted([("1", want), ("1", want), ("2", ""), ("3", ""), ("None", "")])
    assert b.main_text(spark.createDataFrame([], "html string")).collect() == []


def test_batches_do_not_matter():
    made = t.Pages(8)
    pages = [made.page().replace("\ue000", "").replace("\ue001", "") for _ in range(40)] + ["", None]
    x = b.Extractor()
    assert x.texts(pages) == [x.texts([p])[0] for p in pages]


def test_time_is_linear_in_depth_and_in_what_is_left_open():
    n = 50_000
    x = b.Extractor()
    began = time.process_time()
    pages = ["<div>x" * n, "<div>" * n + "<p>x" * 10 + "</span></section>" * n, "<a " * n + "end", "<p><button>" + "<div>y" * n, "<ul>" + "<li><div>z" * n, '<a "' * n + ">tail", "<!--" * n + "x", "a<!-- " + "<b>" * n]
    texts = x.texts(pages)
    assert time.process_time() - began < 60
    assert len(x.parser.blocks(pages[0])) == n and x.parser.blocks(pages[6]) == [] and len(texts) == len(pages)
    assert [t[0] for t in x.parser.blocks("k<!-- open <p>no")] == ["k"] and [t[0] for t in x.parser.blocks("<p>k <a href")] == ["k <a href"]


def test_math_and_object_text_is_read():
    assert cut("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be, <object data=f>fallback</object>.</p>") == ["Let x=2 be, fallback."]


def test_path_sums():
    rng = np.random.default_rng(4)
    table = rng.normal(size=(b.TAGS, 5)).astype(np.float32)
    paths = [p for _, p, _, _ in b.Parser().blocks(PAGE)] + [b.ROOT]
    want = [table[list(p)].sum(axis=0) if len(p) else np.zeros(5) for p in map(tuple, paths)]
    assert np.allclose(b.path_sums(table, paths), want, atol=1e-4) and np.allclose(b.path_sums(table, list(map(tuple, paths))), want, atol=1e-4)
