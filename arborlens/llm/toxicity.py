"""Toxicity: noisy-channel deobfuscation under a character language model, then scoring of the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, tidy, written

#: Rows the classifier is fitted on at most, least toxic texts of a feature and its least gain in log likelihood, the decision, tokens remembered.
LABELLED, LEAST, GAIN, THRESHOLD, CACHED = 12_000, 4, 12.0, 0.3, 400_000
PREFIXES = range(3, 9)

# What a character may stand for in disguised writing, and marks set between letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = set(".-_*~'`·^/\\, \t\n")
EDGE = ".,;:?!()[]{}\"'“”„«»‘’…*_-"

SIZE = 96
TRIPLE = re.compile(r"([^\W\d_])\1\1")
DOUBLE = re.compile(r"([^\W\d_])\1")
TAIL = re.compile(r"([^\w\s])\1{2,}$")
LETTERS = re.compile(r"[^\W\d_]+")


def _codes() -> np.ndarray:
    """Code of each code point: a to z 1 to 26, the Latin-1 letters 27 to 90, other letters 91, else 0 (a boundary)."""
    table = np.zeros(0x110000, np.uint8)
    for p in range(0x3000):
        if chr(p).isalpha():
            table[p] = p - 96 if 97 <= p <= 122 else 27 + p - 192 if 192 <= p <= 255 else 91
    table[0x3000:0xD800] = 91
    return table


_CODES: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    if not _CODES:
        _CODES.append(_codes())
    return _CODES[0][np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def trigram_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(gram, n)``: letter trigrams of every whole text; grams are 3 codes below 96, never two boundaries at the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(SIZE**3, np.int64), [], 0

        def add() -> None:
            c = codes("   " + "".join(held)).astype(np.int32)
            total[:] += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                if (text := text.as_py()) is not None:
                    held.append(f"  {text} ")
                    size += len(text)
                    if size > 1 << 20:
                        add()
                        size = 0
        add()
        total.reshape(SIZE, SIZE * SIZE)[:, 0] = 0  # after two boundaries nothing is decoded
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    return df.select(column(text_col)).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Interpolated trigram costs, -log P(c | a, b), from gram counts."""

    def __init__(self, grams: list[int], counts: list[int]):
        three = np.zeros(SIZE**3)
        three[grams] = counts
        three = three.reshape(SIZE, SIZE, SIZE)
        three[:, 0, 0] = 0
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one + 1).sum()
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).astype(np.float32).ravel().tolist()


def lattice(noisy: str) -> list[list[tuple[str, float]]]:
    """What each run of one character may have been, with the channel's cost."""
    out, k = [], 0
    while k < len(noisy):
        c, n = noisy[k], 1
        while k + n < len(noisy) and noisy[k + n] == c:
            n += 1
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c, 2.5), (c * 2, 0.0)] if n == 2 else [(c, 1.0), (c * 2, 1.2)])
        elif c in LEET:
            once = [(x, 0.7) for x in LEET[c]]
            more = [(x * 2, 1.2) for x in LEET[c]] if n > 1 else []
            out.append([*once, *more, ("", 5.0), (" ", 6.0)])
        elif c in SEPARATORS:
            out.append([("", 1.0), (" ", 4.0)])
        else:
            out.append([(" ", 0.5), ("", 2.0)])
        k += n
    return out


class Restorer:
    """Viterbi decoding of character lattices; the state is the last two letters."""

    def __init__(self, model: CharModel):
        self.cost, self.memo = model.cost, {" ": 0}

    def code(self, c: str) -> int:
        got = self.memo.get(c)
        if got is None:
            got = self.memo[c] = int(codes(c)[0])
        return got

    def restore(self, noisy: str) -> str:
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in [*lattice(noisy), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for text, price in options:
                marks = [self.code(c) for c in text]
                for (a, b), (total, path) in states.items():
                    total += price
                    for c in marks:
                        if b or c:  # runs of boundaries cost nothing
                            total += self.cost[(a * SIZE + b) * SIZE + c]
                        a, b = b, c
                    if (a, b) not in new or total < new[a, b][0]:
                        new[a, b] = (total, (path, text) if text else path)
            states = new
        path = min(states.values(), key=lambda s: s[0])[1]
        parts = []
        while path is not None:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts))

    def words(self, token: str) -> list[str]:
        """The restored words of a token without white space, lower-cased."""
        token = token.lower()
        core = token.strip(EDGE)
        if core.isalpha() and not TRIPLE.search(core):
            return [core]
        if tail := TAIL.search(token):  # a token followed by three marks or more
            core = token[: tail.start()].strip(EDGE)
            if core.isalpha() and not TRIPLE.search(core):
                return [core]
        if not any(c.isalpha() for c in token):
            return []
        plain = LETTERS.findall(token)
        if "".join(plain) == core.replace("-", "").replace("'", "") and len(max(plain, key=len)) > 2 and not TRIPLE.search(core):
            return plain  # hyphens and apostrophes between words
        return LETTERS.findall(self.restore(token.strip(".,;:?\"'")))


def spaced(words: list[str]) -> list[str]:
    """Runs of three or more one-character tokens, as one noisy text each.

    A character set over four times in a row counts as four: to the lattice, three or more are the same.
    """
    if len(words) < 3:
        return []
    single = np.fromiter(map(len, words), np.int32, len(words)) == 1
    if not single.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= 3:
            run = re.sub(r"((\S) )(?:\2 ){3,}", r"\1\1\1\1", " ".join(words[a:b]).lower() + " ").strip()
            if any(c.isalpha() for c in run):
                out.append(run)
    return out


def features(word: str) -> list[str]:
    """The word, marked, and its beginnings."""
    return [f"{word}.", *(word[:n] for n in PREFIXES if n <= len(word))]


class Reader:
    """Restored words of a text and their weights, remembered by token."""

    def __init__(self, model: CharModel, lifts: dict[str, float]):
        self.restorer, self.lifts = Restorer(model), lifts
        self.tokens: dict[str, float] = {}

    def lift(self, words: list[str]) -> float:
        """The sum over the words of the strongest feature's log lift."""
        return sum(max((self.lifts.get(f, 0.0) for f in features(w)), default=0.0) for w in words)

    def token(self, t: str) -> float:
        """The lift of a token's words; if there is none but its letters without hyphens or doubling have some, that of the decoded token."""
        words = self.restorer.words(t)
        if (x := self.lift(words)) or not words:
            return x
        joined = "".join(words)
        single = DOUBLE.sub(r"\1", joined)
        if (len(words) > 1 or single != joined) and (self.lift([joined]) or self.lift([single])):
            return self.lift(LETTERS.findall(self.restorer.restore(t.lower().strip(EDGE))))
        return 0.0

    def restored(self, text: str | None) -> Counter:
        tokens = (text or "").split()
        out: Counter = Counter()
        for t, n in Counter(tokens).items():
            for w in self.restorer.words(t):
                out[w] += n
        for run in spaced(tokens):
            out.update(LETTERS.findall(self.restorer.restore(run)))
        return out

    def measures(self, text: str | None) -> list[float]:
        """What the decision is made from: logs of the lift, of marked tokens and distinct ones; their rate, the largest lift and the length."""
        tokens = (text or "").split()
        get, lifts = self.tokens.get, []
        for t in tokens:
            x = get(t)
            if x is None:
                x = self.token(t)
                if len(self.tokens) < CACHED:
                    self.tokens[t] = x
            if x:
                lifts.append((t, x))
        for run in spaced(tokens):
            if x := self.lift(LETTERS.findall(self.restorer.restore(run))):
                lifts.append((run, x))
        n, total = len(tokens), math.fsum(x for _, x in lifts)
        return [math.log1p(total), math.log1p(len(lifts)), math.log1p(len({t for t, _ in lifts})), 100 * len(lifts) / (n + 20), max((x for _, x in lifts), default=0.0), math.log1p(n), math.log1p(n) * (not lifts)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients with the constant last, means, scales) of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def language_model(df: DataFrame, text_col: str = "text") -> CharModel:
    """The character model of every text; at most 96**3 counts reach the driver."""
    rows = trigram_counts(df, text_col).toPandas()
    return CharModel(rows["gram"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64))


def learn(docs: DataFrame, known: DataFrame, model: CharModel, bound: int = LABELLED) -> tuple[dict[str, float], tuple | None]:
    """(log lift of features, regression) from ``docs`` (id, text) with the labels ``known`` (id, toxic).

    At most ``bound`` labels are used, those with the smallest hash of the id.  Features are words and their
    beginnings in restored texts; kept are those in ``LEAST`` toxic texts or more that tell toxic texts apart
    by ``GAIN`` nats, with the log ratio of their rates among toxic and other words.
    """
    spark = docs.sparkSession
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(bound)
    sample = written(docs.join(F.broadcast(chosen), "id").select("text", (F.col("toxic") > 0).alias("toxic")).repartition(8), "labelled")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    if not n0 or not n1:
        return {}, None
    shared = spark.sparkContext.broadcast(model)

    def tally(only: frozenset | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader, texts, tokens, total = Reader(shared.value, {}), Counter(), Counter(), 0
            for batch in batches:
                for text in batch["text"]:
                    found: Counter = Counter()
                    for w, n in reader.restored(text).items():
                        total += n
                        for f in features(w):
                            if only is None or f in only:
                                found[f] += n
                    texts.update(found.keys())
                    tokens.update(found)
            keys = [*texts, ""]
            yield pd.DataFrame({"feature": keys, "n": [texts[k] for k in keys], "t": [*(tokens[k] for k in keys[:-1]), total]})

        return run

    def counted(toxic: bool, only=None) -> DataFrame:
        return sample.where(F.col("toxic") == toxic).mapInPandas(tidy(tally(only)), "feature string, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))

    bad = {r.feature: (r.n, r.t) for r in counted(True).where(f"n >= {LEAST} or feature = ''").collect()}
    good = {r.feature: (r.n, r.t) for r in counted(False, frozenset(bad)).collect()}
    base, t1, t0 = n1 / (n0 + n1), bad[""][1] + 1, good[""][1] + 1
    lifts = {}
    for f, (a, ta) in bad.items():
        if not f:
            continue
        b, tb = good.get(f, (0, 0))
        share, lift = a / (a + b), math.log((ta + 0.5) / t1) - math.log((tb + 0.5) / t0)
        gain = a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0.0)
        if share > base and gain >= GAIN and lift > 1:
            lifts[f] = lift
    known = spark.sparkContext.broadcast(lifts)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value, known.value)
        for batch in batches:
            yield pd.DataFrame({"x": [reader.measures(t) for t in batch["text"]], "y": batch["toxic"].astype(float)})

    rows = sample.mapInPandas(tidy(measure), "x array<double>, y double").toPandas().sort_values("y", kind="stable")
    return lifts, fit(np.array(rows["x"].tolist()), rows["y"].to_numpy())


def held_out(id_col):
    """crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``df`` with two more columns at the end: ``_score`` (0 to 1) and ``_predicted`` (1 from ``THRESHOLD`` on).

    Other columns pass through; where ``df`` has a column of a result's name, that result gets another underscore.

    The character model counts every text.  Labels are used for rows that are not held out (see
    ``held_out``); ids and other columns are no input.  Null text scores as the empty text; rows with a null
    id are scored and never learnt from; of several labels for an id the highest counts, and null labels
    are left out.  Without labels every score is 0.
    """
    spark = df.sparkSession
    model = language_model(df, text_col)
    known = labels.select(column(id_col).alias("id"), column(label_col).alias("toxic")).where("id is not null and toxic is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    lifts, regression = learn(df.select(column(id_col).alias("id"), column(text_col).alias("text")), known, model)
    shared = spark.sparkContext.broadcast((model, lifts, regression))

    def points_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, lifts, regression = shared.value
        reader = Reader(model, lifts)
        for texts in batches:
            if regression is None or not len(texts):
                yield pd.Series(np.zeros(len(texts)))
                continue
            w, mean, scale = regression
            x = (np.array([reader.measures(t) for t in texts]) - mean) / scale
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return tidy(points_of)(batches)

    points, predicted = fresh(df, "_score", "_predicted")
    return df.withColumn(points, of(column(text_col))).withColumn(predicted, (F.col(points) >= THRESHOLD).cast("int"))


def keep_clean(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, with its columns."""
    scored = score(df, labels, **options)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*map(column, df.columns))
