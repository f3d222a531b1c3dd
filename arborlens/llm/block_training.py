"""Training of the block labeller on generated pages: ``python -m arborlens.llm.block_training``.

Pages are made from templates whose parts are known, so each block's label is known; nothing from any corpus
is used.  The run is seeded and gives the weights that are kept beside this module.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from .blocks import HIDDEN, NUMBERS, TAG_DIM, TAGS, WEIGHTS, WORD_DIM, WORDS, Features, Labeller, Parser, lstm, sigmoid

NOTES = {
    "cookie": "we use cookies to improve your experience accept all cookies privacy policy consent settings",
    "newsletter": "subscribe to our newsletter enter your email sign up now join thousands of readers",
    "comment": "reply says great post thanks for sharing i agree with you comment posted ago",
    "share": "share on facebook twitter email print this page follow us",
    "related": "related posts you may also like more stories read more popular trending recommended",
    "footer": "copyright all rights reserved terms privacy contact about imprint sitemap",
    "menu": "home about contact news products services blog login register search menu",
    "ad": "advertisement sponsored buy now limited offer sale free shipping promoted",
    "sidebar": "recent posts archives categories tags blogroll widgets meta popular",
    "form": "name email message submit send search password username required field",
}


class Pages:
    """Generated pages: html with a mark around each block's words, which tells its label."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.syllables = ["".join(self.rng.choices("bcdfghklmnprstvwz", k=1) + self.rng.choices("aeiouäéíöü", k=1) + self.rng.choices(["", "n", "s", "r", "l", "th", "ng"], k=1)) for _ in range(150)]

    def word(self) -> str:
        return "".join(self.rng.choices(self.syllables, k=self.rng.choice([1, 1, 2, 2, 3])))

    def say(self, low: int, high: int, note: str | None = None, end: bool = True) -> str:
        rng, out = self.rng, []
        left = rng.randint(low, high)
        while left > 0:
            n = min(left, rng.randint(3, 16))
            out.append(" ".join(self.word() for _ in range(n)).capitalize() + (rng.choice(".... !?,"[:8]).strip() if end else ""))
            left -= n
        text = " ".join(out)
        if note and rng.random() < 0.6:
            words = NOTES[note].split()
            text = " ".join(rng.sample(words, rng.randint(1, min(6, len(words))))) + " " + text
        return text

    def mark(self, text: str, main: bool) -> str:
        return f"{'\ue001' if main else '\ue000'}{text}"

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def wrap(self, inner: str, options: list[str]) -> str:
        tag, _, name = self.rng.choice(options).partition(".")
        if not name:
            return f"<{tag}>{inner}</{tag}>"
        kind = self.rng.choice(["class", "class", "id"])
        extra = self.rng.choice(["", "", f" {self.word()}", f"-{self.word()}"])
        return f'<{tag} {kind}="{name}{extra}">{inner}</{tag}>'

    def items(self, n: int, note: str, linked: float = 0.9, low: int = 1, high: int = 3) -> str:
        out = []
        for _ in range(n):
            t = self.mark(self.say(low, high, note if self.rng.random() < 0.3 else None, end=self.rng.random() < 0.1), False)
            out.append(f"<li>{self.link(t) if self.rng.random() < linked else t}" + self.rng.choice(["</li>", "</li>", ""]))
        return f"<ul>{''.join(out)}</ul>"

    def boilerplate(self, kind: str) -> str:
        rng = self.rng
        p = lambda low, high, note, tag="p": f"<{tag}>{self.mark(self.say(low, high, note), False)}</{tag}>"
        if kind == "menu":
            return self.wrap(self.items(rng.randint(3, 12), "menu"), ["nav", "nav", "nav.main", "div.menu", "div.navbar", "ul.navigation", "div.topnav", "menu", "div.breadcrumbs"])
        if kind == "header":
            inner = rng.choice([f"<h1>{self.mark(self.say(1, 5, end=False), False)}</h1>", self.mark(self.say(1, 6, end=False), False), f"<div>{self.mark(self.say(2, 8), False)}</div>"]) + (p(2, 10, None) if rng.random() < 0.4 else "")
            return self.wrap(inner + (self.boilerplate("menu") if rng.random() < 0.3 else ""), ["header", "header", "header.site", "div.header", "div.masthead", "div.banner", "div.site-title"])
        if kind == "ad":
            text = self.mark(self.say(3, 40, "ad"), False)
            return self.wrap(rng.choice([text, f"<p>{text}</p>", self.link(text)]), ["div.ad", "div.ad", "div.ads", "div.advert", "aside.ad", "div.sponsored", "div.promo", "div.advertisement", "section.ad", "ins.ad"[:0] or "div.adsbox"])
        if kind == "notice":
            return self.wrap(p(3, 40, "cookie", rng.choice(["p", "div", "span"])) + (f"<button>{self.mark(self.say(1, 2, end=False), False)}</button>" if rng.random() < 0.6 else ""), ["div.cookie", "div.cookie-banner", "div.notice", "div.consent", "div.gdpr", "section.notice", "div.alert", "aside.notice", "dialog", "div.popup", "div.notification"])
        if kind == "newsletter":
            return self.wrap(p(3, 25, "newsletter") + self.boilerplate("form"), ["div.newsletter", "section.subscribe", "div.signup", "aside"])
        if kind == "form":
            parts = "".join(f"<label>{self.mark(self.say(1, 3, 'form', False), False)}</label><input>" + rng.choice(["", "<br>", "</p><p>"]) for _ in range(rng.randint(1, 4)))
            return f"<form>{rng.choice(['', p(2, 14, 'form')])}<div>{parts}</div><button>{self.mark(self.say(1, 2, 'form', False), False)}</button></form>"
        if kind == "sidebar":
            inner = "".join(rng.choice([lambda: f"<h3>{self.mark(self.say(1, 4, 'sidebar', False), False)}</h3>" + self.items(rng.randint(2, 8), "sidebar", low=2, high=8), lambda: p(5, 60, "sidebar"), lambda: self.boilerplate("ad")])() for _ in range(rng.randint(1, 4)))
            return self.wrap(inner, ["aside", "aside", "aside.sidebar", "div.sidebar", "div.widget", "section.sidebar", "div.side", "div.rail"])
        if kind == "comments":
            one = lambda: self.wrap(rng.choice(["", f"<h4>{self.mark(self.say(1, 3, end=False), False)}</h4>"]) + "".join(p(4, 90, "comment", rng.choice(["p", "p", "div"])) for _ in range(rng.randint(1, 3))), ["div.comment", "li.comment", "article.comment", "div.reply", "div.comment-body", "div"])
            inner = rng.choice(["", f"<h2>{self.mark(self.say(1, 4, 'comment', False), False)}</h2>"]) + "".join(one() for _ in range(rng.randint(1, 7))) + (self.boilerplate("form") if rng.random() < 0.4 else "")
            return self.wrap(inner, ["section.comments", "div.comments", "ol.commentlist", "div.comment-list", "div.disqus", "section.discussion", "div.responses", "div.reader-comments", "section.replies"])
        if kind == "related":
            return self.wrap(f"<h3>{self.mark(self.say(1, 4, 'related', False), False)}</h3>" + self.items(rng.randint(2, 8), "related", low=3, high=12), ["div.related", "section.related", "div.recommended", "aside.more", "div.popular", "nav.related"])
        if kind == "share":
            return self.wrap(self.items(rng.randint(2, 5), "share"), ["div.share", "div.social", "ul.sharing"])
        text = self.mark(rng.choice(["© ", "&copy; ", ""]) + self.say(3, 60, "footer"), False)
        return self.wrap(rng.choice([text, f"<p>{text}</p>", text + self.items(rng.randint(2, 7), "footer")]), ["footer", "footer", "footer", "footer.site", "div.footer", "div.bottom", "div.copyright"])

    def article(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.85:
            title = f"<h1>{self.mark(self.say(2, 12, end=rng.random() < 0.3), True)}</h1>"
            out.append(rng.choice([title, title, f"<header>{title}</header>"]))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 14, 30]) if rng.random() < 0.9 else 80):
            r = rng.random()
            text = lambda low, high: self.inline(self.mark(self.prose(low, high), True))
            if r < 0.62:
                out.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p><em>{}</em></p>"]).format(text(*rng.choice([(1, 4), (4, 30), (20, 200)]))))
            elif r < 0.70:
                out.append(f"<h{(k := rng.randint(2, 4))}>{text(1, 9)}</h{k}>")
            elif r < 0.78:
                out.append("<ul>" + "".join(f"<li>{text(1, 25)}" + rng.choice(["</li>", ""]) for _ in range(rng.randint(1, 6))) + "</ul>")
            elif r < 0.83:
                out.append(f"<blockquote><p>{text(5, 60)}</p></blockquote>")
            elif r < 0.86:
                out.append(f"<pre>{text(3, 40)}</pre>")
            elif r < 0.89:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{text(1, 6)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif r < 0.91:
                out.append(f"<figure><img><figcaption>{text(2, 15)}</figcaption></figure>")
            elif r < 0.94:
                out.append(f"<div>{text(3, 80)}</div>")
            else:
                out.append(self.boilerplate(rng.choice(["ad", "ad", "sidebar", "share", "newsletter", "form", "notice", "related"])))
        inner = "".join(out)
        if rng.random() < 0.3:
            inner = self.wrap(inner, ["div", "div.entry", "div.body", "section", "div.text"])
        return self.wrap(inner, ["article", "article", "article", "article", "article.post", "main", "main", "div.content", "div.article", "div.post", "div.entry-content", "div.main", "section.story", "div.article-body"])

    def prose(self, low: int, high: int) -> str:
        """Text of an article, which may hold any words, repeat itself or be very short."""
        r = self.rng.random()
        if r < 0.12:
            return self.say(0, 3) + " " + " ".join(self.rng.sample(words := NOTES[self.rng.choice(list(NOTES))].split(), min(len(words), self.rng.randint(2, 6)))).capitalize() + "."
        if r < 0.18:
            return " ".join([self.say(1, 4)] * self.rng.randint(1, 60))
        return self.say(low, high)

    def inline(self, text: str) -> str:
        rng = self.rng
        if rng.random() < 0.25 and " " in text:
            words = text.split(" ")
            k = rng.randrange(len(words))
            if k:
                words[k] = rng.choice(["<a href=#>{}</a>", "<i>{}</i>", "<b>{}</b>", "{}&amp;", "<code>{}</code>"]).format(words[k])
            text = " ".join(words)
        return text

    def page(self) -> str:
        rng = self.rng
        some = lambda kinds, p: [self.boilerplate(k) for k in kinds if rng.random() < p]
        top, side, end = some(["notice"], 0.3) + some(["header"], 0.5) + some(["menu"], 0.75) + some(["ad"], 0.5), some(["sidebar"], 0.3), some(["share"], 0.15) + some(["comments"], 0.4) + some(["related"], 0.25) + some(["ad", "newsletter", "form", "notice"], 0.12) + some(["footer"], 0.85)
        if rng.random() < 0.3:
            rng.shuffle(top)
        article = [self.article()] if rng.random() < 0.96 else []
        if rng.random() < 0.3:
            article = side + article
        else:
            article = article + side
        body = "".join(article)
        if rng.random() < 0.25:
            body = self.wrap(body, ["div", "div.container", "div.wrapper", "div.page", "main"])
        return f"<html><head><title>x</title></head><body>{''.join(top)}{body}{''.join(end)}</body></html>"


def labelled(pages: list[str]) -> list[tuple[tuple, np.ndarray]]:
    parser, features, out = Parser(), Features(), []
    for page in pages:
        blocks, y = [], []
        for text, path, linked, tag in parser.blocks(page):
            marks = {c for c in text if c in "\ue000\ue001"}
            text = " ".join(text.replace("\ue000", "").replace("\ue001", "").split())
            if text:
                blocks.append((text, tuple(path), min(linked, len(text)), tag))
                y.append(float(marks == {"\ue001"}))
        if blocks:
            out.append((features.page(blocks), np.array(y, np.float32)))
    return out


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = TAG_DIM + WORD_DIM + NUMBERS
    w = {"tags": rng.normal(0, 0.3, (TAGS, TAG_DIM)), "words": rng.normal(0, 0.1, (WORDS, WORD_DIM)), "out": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
    for s in "fb":
        w |= {f"w{s}": rng.normal(0, d**-0.5, (d, 4 * HIDDEN)), f"u{s}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"b{s}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _back(kept: list, x: np.ndarray, dh_out: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    steps, pages, _ = x.shape
    hidden = u.shape[0]
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * hidden, np.float32), np.zeros_like(x)
    dh, dc = np.zeros((pages, hidden), np.float32), np.zeros((pages, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tanh, m = kept[t]
        dh = dh + dh_out[t]
        through, dc_through = np.where(m, 0, dh), np.where(m, 0, dc)
        e = np.where(m, dh, 0)
        d = np.where(m, dc, 0) + e * o * (1 - tanh**2)
        z = np.concatenate([d * g * i * (1 - i), d * c * f * (1 - f), e * tanh * o * (1 - o), d * i * (1 - g**2)], axis=1)
        dw += x[t].T @ z
        du += h.T @ z
        db += z.sum(axis=0)
        dx[t] = z @ w.T
        dh, dc = z @ u.T + through, d * f + dc_through
    return dw, du, db, dx


def gradients(model: Labeller, pages: list[tuple], ys: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of the blocks and its gradient."""
    w = model.w
    x, mask = model.inputs(pages)
    y = np.zeros(mask.shape, np.float32)
    for k, v in enumerate(ys):
        y[: len(v), k] = v
    kf: list = []
    kb: list = []
    hf = lstm(x, mask, w["wf"], w["uf"], w["bf"], kf)
    hb = lstm(x[::-1], mask[::-1], w["wb"], w["ub"], w["bb"], kb)[::-1]
    h = np.concatenate([hf, hb], axis=2)
    p = sigmoid(h @ w["out"] + w["bias"])[:, :, 0]
    n = mask.sum()
    loss = -float((np.where(mask, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0)).sum() / n)
    dz = np.where(mask, p - y, 0)[:, :, None].astype(np.float32) / n
    g = {"out": np.einsum("tph,tpo->ho", h, dz), "bias": dz.sum(axis=(0, 1))}
    dh = dz @ w["out"].T
    g["wf"], g["uf"], g["bf"], dx = _back(kf, x, dh[:, :, :HIDDEN], w["wf"], w["uf"])
    g["wb"], g["ub"], g["bb"], more = _back(kb, x[::-1], dh[::-1, :, HIDDEN:], w["wb"], w["ub"])
    dx = dx + more[::-1]
    g["tags"], g["words"] = np.zeros_like(w["tags"]), np.zeros_like(w["words"])
    for k, (words, paths, _) in enumerate(pages):
        for t, (a, b) in enumerate(zip(words, paths, strict=True)):
            if len(b):
                np.add.at(g["tags"], np.asarray(b), dx[t, k, :TAG_DIM])
            if len(a):
                np.add.at(g["words"], np.asarray(a), dx[t, k, TAG_DIM : TAG_DIM + WORD_DIM] / len(a))
    return loss, g


def train(n_pages: int = 4000, epochs: int = 14, seed: int = 7, batch: int = 32, log=None) -> dict[str, np.ndarray]:
    made = Pages(seed)
    data = labelled([made.page() for _ in range(n_pages)])
    data.sort(key=lambda d: len(d[1]))
    batches = [data[k : k + batch] for k in range(0, len(data), batch)]
    model, rng = Labeller(initial(seed)), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        total, rate = 0.0, 4e-3 * (1 - epoch / epochs) + 2e-4
        for b in rng.permutation(len(batches)):
            pages, ys = zip(*batches[b], strict=True)
            dropped = [([[] if rng.random() < 0.5 else v for v in words], [[x for x in v if rng.random() > 0.08] for v in paths], numbers) for words, paths, numbers in pages]
            loss, g = gradients(model, dropped, list(ys))
            total, step = total + loss, step + 1
            norm = float(np.sqrt(sum((v**2).sum() for v in g.values())))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v**2
                model.w[k] = model.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if log:
            print(epoch, round(total / len(batches), 4), file=log, flush=True)
    return model.w


def accuracy(model: Labeller, pages: list[str]) -> float:
    data = labelled(pages)
    right = total = 0
    for k in range(0, len(data), 64):
        part = data[k : k + 64]
        for (_, y), p in zip(part, model.probabilities([d[0] for d in part]), strict=True):
            right, total = right + int(((p >= 0.5) == (y > 0.5)).sum()), total + len(y)
    return right / total


if __name__ == "__main__":
    weights = train(log=sys.stderr)
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in weights.items()})
    held = Pages(99)
    print("held-out block accuracy", accuracy(Labeller(), [held.page() for _ in range(500)]))
