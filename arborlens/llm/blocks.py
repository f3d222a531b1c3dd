"""HTML main text: a recurrent labeller of leaf blocks, a bidirectional LSTM in numpy."""

from __future__ import annotations

import html
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh

WEIGHTS = os.path.join(os.path.dirname(__file__), "block_weights.npz")
TAGS, WORDS, TAG_DIM, WORD_DIM, NUMBERS, HIDDEN = 1024, 2048, 16, 8, 8, 24

# Element kinds of the HTML standard.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = frozenset("head template noscript svg canvas audio video select datalist".split())
BLOCK = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
KEEPS_P = ("table", "td", "th", "button", "caption")
SCOPES = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?/][^>]*>""", re.S)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]{2,}")
PUNCTUATION = re.compile(r"[.,;:!?。，]")


def bucket(kind: str, name: str, n: int) -> int:
    return zlib.crc32(f"{kind}:{name}".encode("utf-8", "surrogatepass")) % n


class Path:
    """The open elements of a block, as a link to the parent's path: iterates over all buckets, from the root on."""

    __slots__ = ("parent", "tag", "own", "size")

    def __init__(self, parent: Path | None, tag: str, own: tuple[int, ...]):
        self.parent, self.tag, self.own = parent, tag, own
        self.size = len(own) + (parent.size if parent else 0)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        chain, node = [], self
        while node is not None:
            chain.append(node.own)
            node = node.parent
        return (b for own in reversed(chain) for b in own)


ROOT = Path(None, "", ())


def path_sums(table: np.ndarray, paths: list) -> np.ndarray:
    """The sum of the table's rows over each path; what paths share is added once."""
    known, single, out = {}, {(): np.zeros(table.shape[1], np.float32)}, np.zeros((len(paths), table.shape[1]), np.float32)
    for k, path in enumerate(paths):
        if not isinstance(path, Path):
            if len(path):
                out[k] = table[np.asarray(path)].sum(axis=0)
            continue
        chain, node = [], path
        while node is not None and id(node) not in known:
            chain.append(node)
            node = node.parent
        total = known[id(node)] if node is not None else single[()]
        for node in reversed(chain):
            if node.own not in single:
                single[node.own] = table[list(node.own)].sum(axis=0)
            total = known[id(node)] = total + single[node.own]
        out[k] = total
    return out


class Parser:
    """Cuts a page into leaf blocks: (text, buckets of the tag path, characters inside links, innermost tag).

    Time and memory are linear in the page, however deep its elements are nested and whatever is left open.
    """

    def __init__(self):
        self.elements: dict[tuple[str, str], tuple[int, ...]] = {}
        self.ends: dict[str, re.Pattern] = {}

    def element(self, tag: str, attributes: str) -> tuple[int, ...]:
        key = (tag, attributes)
        got = self.elements.get(key)
        if got is None:
            names = [bucket("tag", tag, TAGS)]
            for m in NAMED.finditer(attributes):
                names += [bucket("name", p, TAGS) for p in PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower())]
            got = tuple(names)
            if len(self.elements) < 50_000:
                self.elements[key] = got
        return got

    def blocks(self, page: str) -> list[tuple[str, Path, int, str]]:
        out, buffer, linked, in_link, silent = [], [], 0, False, 0
        stack: list[Path] = []
        places: dict[str, list[int]] = defaultdict(list)  # where the stack has an element
        at, n = 0, len(page)
        closed = page.rfind(">") + 1  # no tag ends after it

        def take(raw: str) -> None:
            nonlocal linked
            if silent or not raw:
                return
            text = html.unescape(raw) if "&" in raw else raw
            if in_link:
                linked += len(text.strip())
            buffer.append(text)

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    path = stack[-1] if stack else ROOT
                    out.append((text, path, min(linked, len(text)), path.tag))
                buffer.clear()
            linked = 0

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places[t]), default=-1)

        def pop_to(k: int) -> None:
            nonlocal silent
            while len(stack) > k:
                tag = stack.pop().tag
                places[tag].pop()
                silent -= tag in SILENT

        while at < n:
            m = TOKEN.search(page, at, closed) if at < closed else None
            if not m:
                rest = page[at:]
                take(rest[: rest.find("<!--")] if "<!--" in rest else rest)
                break
            take(page[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                if at == closed and m[0].startswith("<!--") and not m[0].endswith("-->"):
                    break  # a comment that does not end
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "a":
                    in_link = False
                elif tag in BLOCK or tag in SILENT:
                    flush()
                    in_link = False
                    if places[tag]:
                        pop_to(places[tag][-1])
            elif tag in RAW:
                end = self.ends.setdefault(tag, re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I)).search(page, at)
                at = end.end() if end else n
            elif tag == "br":
                take(" ")
            elif tag == "a":
                in_link = True
            elif tag in BLOCK or tag in SILENT:
                flush()
                in_link = False
                if tag in CLOSES_P and (k := last(("p",))) > last(KEEPS_P):
                    pop_to(k)
                if tag in SCOPES:
                    closes, stops = SCOPES[tag]
                    if (k := last(closes)) > last(stops):
                        pop_to(k)
                if tag == "body" and places["head"]:
                    pop_to(places["head"][0])
                if tag not in VOID:
                    places[tag].append(len(stack))
                    stack.append(Path(stack[-1] if stack else ROOT, tag, self.element(tag, m[3])))
                    silent += tag in SILENT
                    if tag == "svg" and m[3].endswith("/"):
                        pop_to(len(stack) - 1)
        flush()
        return out


class Features:
    """Arrays of a batch of pages' blocks."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in text.lower().split():
            b = known.get(w)
            if b is None:
                b = bucket("word", w.strip(".,;:!?()\"'"), WORDS)
                if len(known) < 300_000:
                    known[w] = b
            out.append(b)
        return out

    def page(self, blocks: list) -> tuple[list, list, np.ndarray]:
        n = len(blocks)
        numbers = np.empty((n, NUMBERS), np.float32)
        words, paths = [], []
        for k, (text, path, linked, tag) in enumerate(blocks):
            w = self.words(text)
            words.append(w)
            paths.append(path)
            size = len(text)
            numbers[k] = (np.log1p(size) / 6, np.log1p(len(w)) / 4, linked / size, min(1.0, 8 * len(PUNCTUATION.findall(text)) / size), tag == "p", len(path) / 16, k / n, text[-1] in ".!?。")
        return words, paths, numbers


def _mean(table: np.ndarray, lists: list) -> np.ndarray:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.zeros((len(lists), table.shape[1]), np.float32)
    full = sizes > 0
    if full.any():
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists if len(x)])
        out[full] = np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(sizes[full])[:-1]]))
    return out / np.maximum(sizes, 1)[:, None].astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states [steps, pages, hidden] of x [steps, pages, inputs]; masked steps leave the state as it is."""
    steps, pages, _ = x.shape
    hidden = u.shape[0]
    h, c = np.zeros((pages, hidden), np.float32), np.zeros((pages, hidden), np.float32)
    out = np.empty((steps, pages, hidden), np.float32)
    inputs = x @ w + b
    for t in range(steps):
        z = inputs[t] + h @ u
        i, f, o = sigmoid(z[:, :hidden]), sigmoid(z[:, hidden : 2 * hidden]), sigmoid(z[:, 2 * hidden : 3 * hidden])
        g = np.tanh(z[:, 3 * hidden :])
        m = mask[t][:, None]
        new = f * c + i * g
        tanh = np.tanh(new)
        if keep is not None:
            keep.append((h, c, i, f, o, g, tanh, m))
        h, c = np.where(m, o * tanh, h), np.where(m, new, c)
        out[t] = h
    return out


class Labeller:
    """Path and word embeddings, a forward and a backward LSTM over a page's blocks, and a logistic output."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            with np.load(WEIGHTS) as kept:
                weights = {k: kept[k].astype(np.float32) for k in kept.files}
        self.w = weights

    def inputs(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p[2]) for p in pages)
        x = np.zeros((steps, len(pages), TAG_DIM + WORD_DIM + NUMBERS), np.float32)
        mask = np.zeros((steps, len(pages)), bool)
        tags = path_sums(self.w["tags"], [v for p in pages for v in p[1]])
        words = _mean(self.w["words"], [v for p in pages for v in p[0]])
        at = 0
        for k, (_, _, numbers) in enumerate(pages):
            n = len(numbers)
            x[:n, k, :TAG_DIM], x[:n, k, TAG_DIM : TAG_DIM + WORD_DIM], x[:n, k, TAG_DIM + WORD_DIM :] = tags[at : at + n], words[at : at + n], numbers
            mask[:n, k] = True
            at += n
        return x, mask

    def probabilities(self, pages: list[tuple]) -> list[np.ndarray]:
        """P(main text) of each block of pages with one block at least."""
        x, mask = self.inputs(pages)
        w = self.w
        forward = lstm(x, mask, w["wf"], w["uf"], w["bf"])
        backward = lstm(x[::-1], mask[::-1], w["wb"], w["ub"], w["bb"])[::-1]
        p = sigmoid(np.concatenate([forward, backward], axis=2) @ w["out"] + w["bias"])[:, :, 0]
        return [p[: len(pages[k][2]), k] for k in range(len(pages))]


class Extractor:
    def __init__(self, labeller: Labeller | None = None):
        self.parser, self.features, self.labeller = Parser(), Features(), labeller or Labeller()

    def texts(self, pages: list[str | None]) -> list[str]:
        """Main text of each page: the blocks labelled so, joined by line feeds."""
        blocks = [self.parser.blocks(p) if p else [] for p in pages]
        out = [""] * len(pages)
        order = sorted((k for k, b in enumerate(blocks) if b), key=lambda k: len(blocks[k]))
        while order:
            most = len(blocks[order[-1]])
            group = [order.pop()]
            while order and len(group) < 128 and (len(group) + 1) * most <= 1 << 14:
                group.append(order.pop())
            for k, p in zip(group, self.labeller.probabilities([self.features.page(blocks[k]) for k in group]), strict=True):
                out[k] = "\n".join(b[0] for b, q in zip(blocks[k], p, strict=True) if q >= 0.5)
        return out


def main_text(df: DataFrame, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """``df`` with ``out_col`` at the end, the main text of ``html_col``; null or empty pages give the empty text.

    Other columns pass through; where ``df`` has a column of that name, the result gets an underscore before it.

    Every leaf block of the whole page is labelled with the page's other blocks as context; what is labelled
    main text is kept in page order, with white space inside a block as one space.
    """
    made: list[Extractor] = []

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not made:
            made.append(Extractor())
        for pages in batches:
            texts: list[str] = []
            for k in range(0, len(pages), 512):
                texts += made[0].texts(pages[k : k + 512].tolist())
            yield pd.Series(texts, dtype=object)

    return df.withColumn(fresh(df, out_col), of(column(html_col)))
