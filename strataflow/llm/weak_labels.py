"""Quality classifier from weak labels: heuristics vote, EM weighs them, a hashed linear scorer generalises."""

from __future__ import annotations

import re
from collections import Counter
from typing import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import map_rows, text_key, texts

DIMENSIONS = 4096
SAMPLE = 4000  # documents the scorer is trained on, about
CACHE = 100_000
SYMBOLS = re.compile(r"[^\w\s.,;:'\"()-]")
GOOD, BAD, ABSTAIN = 1, -1, 0


# ---- Labellers: each says good, bad or nothing ---------------------------------------------------


def _vote(value: float, good: bool, bad: bool) -> int:
    return GOOD if good else BAD if bad else ABSTAIN


def by_length(text: str, words: list[str]) -> int:
    return _vote(len(words), len(words) >= 40, len(words) < 8)


def by_word_length(text: str, words: list[str]) -> int:
    mean = sum(map(len, words)) / max(1, len(words))
    return _vote(mean, 3 <= mean <= 8.5, mean < 2 or mean > 12)


def by_symbols(text: str, words: list[str]) -> int:
    share = len(SYMBOLS.findall(text)) / max(1, len(text))
    return _vote(share, share < 0.01, share > 0.08)


def by_capitals(text: str, words: list[str]) -> int:
    upper, lower = sum(map(str.isupper, words)), max(1, len(words))
    return _vote(upper, upper < 0.15 * lower, upper > 0.5 * lower)


def by_repeated_words(text: str, words: list[str]) -> int:
    same = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
    return _vote(same, same < 0.04, same > 0.15)


def by_vocabulary(text: str, words: list[str]) -> int:
    if len(words) < 30:
        return ABSTAIN
    top = Counter(words).most_common(1)[0][1] / len(words)
    return _vote(top, top < 0.12, top > 0.25)


def by_repeated_lines(text: str, words: list[str]) -> int:
    lines = [x for x in text.split("\n") if x.strip()]
    extra = len(lines) - len(set(lines))
    return _vote(extra, len(lines) > 1 and extra == 0, extra > 0.3 * len(lines))


def by_sentences(text: str, words: list[str]) -> int:
    ends = sum(w[-1] in ".!?" for w in words) / max(1, len(words))
    return _vote(ends, 0.01 <= ends <= 0.4, ends > 0.6)


def by_short_words(text: str, words: list[str]) -> int:
    short = sum(len(w) <= 3 and w.isalpha() for w in words) / max(1, len(words))
    return _vote(short, short >= 0.15, len(words) >= 12 and short < 0.08)


def by_marked_words(text: str, words: list[str]) -> int:
    marked = sum(w[-2:] == 2 * w[-1] and not w[-1].isalnum() for w in words) / max(1, len(words))
    return _vote(marked, marked < 0.02, marked > 0.1)


def by_bare_marks(text: str, words: list[str]) -> int:
    bare = sum(len(w) < 3 and not any(map(str.isalnum, w)) for w in words) / max(1, len(words))
    return _vote(bare, bare < 0.02, bare > 0.1)


LABELLERS = (
    by_length,
    by_word_length,
    by_symbols,
    by_capitals,
    by_repeated_words,
    by_vocabulary,
    by_repeated_lines,
    by_sentences,
    by_short_words,
    by_marked_words,
    by_bare_marks,
)


def votes(text: str) -> str:
    """One character per labeller: + - 0."""
    words = text.split()
    return "".join("-0+"[f(text, words) + 1] for f in LABELLERS)


# ---- Expectation-maximisation over vote patterns --------------------------------------------------


def estimate(patterns: list[str], counts: list[int], rounds: int = 60, prior: float = 0.8):
    """Share of good documents, per labeller P(vote | bad) and P(vote | good), and P(good | pattern).

    Labellers are independent given the class; their accuracies are unknown and estimated from how they
    agree. The start is the balance of votes; half a document of each kind keeps every rate above zero.
    """
    table = np.array([["-0+".index(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), len(LABELLERS))
    n = np.array(counts, float)
    balance = (table - 1).sum(1)
    good = np.clip(0.5 + balance / (2.0 * len(LABELLERS)) + (prior - 0.5) * 0.2, 0.02, 0.98)
    for _ in range(rounds):
        rates = np.empty((2, len(LABELLERS), 3))
        for c, weight in enumerate((n * (1 - good), n * good)):
            for k in range(len(LABELLERS)):
                seen = np.bincount(table[:, k], weight, 3) + 0.5
                rates[c, k] = seen / seen.sum()
        prior = (n @ good + 1) / (n.sum() + 2)
        each = np.arange(len(LABELLERS))
        log = [np.log(rates[c][each, table]).sum(1) for c in (0, 1)]
        odds = np.clip(log[1] - log[0] + np.log(prior / (1 - prior)), -30, 30)
        good = 1 / (1 + np.exp(-odds))
    return prior, rates, dict(zip(patterns, good.tolist()))


# ---- Hashed linear scorer -------------------------------------------------------------------------


MARKS = ".,;:!?*#$%&|()[]{}<>\"'"


def shape(word: str) -> str:
    """Kind of the letters or digits, and the first marks after them."""
    core = word.rstrip(MARKS)
    if core.isalpha():
        kind = "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "Aa"
    else:
        kind = "0" if core.isdigit() else "x" if core.isalnum() else "?" if core else ""
    return kind + word[len(core) : len(core) + 3]


class Hasher:
    """Unit-length vector of a text's hashed words, word shapes and repetitions."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _places(self, word: str) -> int:
        low = xxhash.xxh64_intdigest("w" + word.lower()) % DIMENSIONS
        return low * DIMENSIONS + xxhash.xxh64_intdigest("s" + shape(word)) % DIMENSIONS

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        known.update((w, self._places(w)) for w in set(words).difference(known))
        places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        at = np.concatenate(np.divmod(places, DIMENSIONS))
        out = np.sqrt(np.bincount(at, minlength=DIMENSIONS)).astype(np.float32)
        out[0] += np.float32(np.sqrt(np.count_nonzero(places[1:] == places[:-1])))
        return out / np.float32(max(1e-6, np.sqrt(out @ out)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam; classes weigh the same."""
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = (y / share + (1 - y) / (1 - share)) / 2
    w, b = np.zeros(x.shape[1] + 1, np.float32), 0.0
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    m = v = np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ ((p - y) * weight).astype(np.float32) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def distinct_sample(read: DataFrame, distinct: int, sample: int) -> DataFrame:
    """``rk``, ``text`` of about ``sample`` of the ``distinct`` texts, each once however many rows repeat it.

    A few more are drawn, so that chance leaves none of the sample out.
    """
    share = (sample + 6 * sample**0.5 + 20) / max(1, distinct)
    some = read.filter(F.pmod(F.xxhash64("rk"), F.lit(1 << 40)) / F.lit(float(1 << 40)) < share)
    return some.groupBy("rk").agg(F.min("text").alias("text"))


def classify(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """``doc_id``, ``score``, ``keep`` of every row.

    Votes are counted over the whole table (at most 3^11 patterns reach the driver); the scorer learns
    the posteriors on at most ``sample`` distinct texts, drawn by their hash. ``score`` is its probability of good
    quality, ``keep`` that it is at least ``least``. A null text counts as empty; a text without words has
    score 0. Equal texts score alike. An empty table gives an empty table.
    """
    read = texts(docs).withColumn("rk", text_key())

    def voted(batches: Iterator[dict]):
        for b in batches:
            for i, k, t in zip(b["doc_id"], b["rk"], b["text"]):
                yield i, k, votes(t)

    seen = materialise(map_rows(read, voted, "doc_id long, rk long, votes string"), "votes")
    patterns = seen.groupBy("votes").count().orderBy("votes").toArrow().to_pydict()
    if not patterns["votes"]:
        return seen.select("doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("keep"))
    _, _, good = estimate(patterns["votes"], patterns["count"])

    drawn = distinct_sample(read, seen.agg(F.count_distinct("rk")).first()[0], sample)

    def hashed(batches: Iterator[dict]):
        vector = Hasher()
        for b in batches:
            for k, t in zip(b["rk"], b["text"]):
                x = vector(t)
                yield k, votes(t), np.flatnonzero(x).tolist(), x[x != 0].tolist()

    got = map_rows(drawn, hashed, "rk long, votes string, at array<int>, value array<float>").toArrow()
    got = got.sort_by("rk").slice(0, sample).to_pydict()
    x = np.zeros((max(1, len(got["votes"])), DIMENSIONS), np.float32)
    for row, at, value in zip(x, got["at"], got["value"]):
        row[at] = value
    y = np.array([good[v] for v in got["votes"]] or [1.0], np.float32)
    order = np.lexsort((x @ np.arange(DIMENSIONS, dtype=np.float32), y))  # one order of summing
    weights, bias = fit(x[order], y[order])

    def scored(batches: Iterator[dict]):
        vector = Hasher()
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                x = vector(t)
                score = float(1 / (1 + np.exp(-float(x @ weights) - bias))) if x.any() else 0.0
                yield i, score, score >= least

    return map_rows(read, scored, "doc_id long, score double, keep boolean")
