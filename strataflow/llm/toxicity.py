"""Toxicity scores by logistic regression on hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Every coordinate has a learning rate of its own, and the L1 term keeps coordinates at zero until they
have earned a weight; so the model that travels to the executors is short.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import map_rows, text_key, texts
from .language import held_out

BITS = 18  # places of hashed features
SAMPLE = 4000  # distinct texts of each class the model learns from, at most
FEATURES = 1 << 24  # their features together, at most
CACHE = 200_000  # words a worker remembers
THRESHOLD = 0.7

# Letters and digits of ASCII in lower case and all bytes beyond it make words; the rest parts them.
_PARTS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class Grams:
    """Hash places of a text's words, of neighbouring words, and of words with one between them."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_PARTS).split()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(known))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = h[:-1] * _ODD + h[1:]
        skips = h[:-2] * _MIX + h[2:]
        every = np.concatenate([h, pairs, skips]) * _ODD
        return (every >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal for logistic loss: z gathers gradients, n their squares, weights follow from both."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, rate = self.z[at], (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / rate, 0.0)

    def learn(self, at: np.ndarray, y: float, weight: float = 1.0) -> float:
        """One example whose features ``at`` are present; returns its probability before learning."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = weight * (p - y)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return float(p)


def fit(examples: list[tuple[np.ndarray, float]], epochs: int = 8, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not zero; place 2^BITS is the intercept. Classes weigh the same in all."""
    model = Ftrl((1 << BITS) + 1)
    ones = sum(y for _, y in examples)
    share = min(max(ones / max(1, len(examples)), 0.02), 0.98)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            at, y = examples[k]
            model.learn(np.append(at, 1 << BITS), y, 0.5 / (share if y else 1 - share))
    w = model.weights()
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at]


class Scorer:
    """Probability of the label from a text."""

    def __init__(self, at: np.ndarray, weights: np.ndarray):
        self.table = np.zeros((1 << BITS) + 1)
        self.table[at] = weights
        self.grams = Grams()

    def __call__(self, text: str) -> float:
        at = self.grams(text)
        at = np.unique(at[self.table[at] != 0])
        z = self.table[-1] + self.table[at].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES):
    """Features and label of at most ``sample`` distinct texts of each class, in an order of their hash.

    A text is one example however many rows repeat it; its label is the more frequent one of its labelled rows
    that are not held out (1 at a tie). Only keys of the sample, then its features, reach the driver. Whole texts count;
    where their features exceed ``features``, the last texts in that order are left out.
    """
    rows = texts(docs).filter(F.col("doc_id").isNotNull() & ~held_out()).withColumn("rk", text_key())
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    said = said.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    votes = said.groupBy("doc_id").agg(F.sum(2 * F.col("y") - 1).alias("v"))
    known = rows.select("doc_id", "rk").join(votes, "doc_id")
    each = known.groupBy("rk").agg(F.sum(F.when(F.col("v") >= 0, 1).otherwise(-1)).alias("v"))
    each = materialise(each.select("rk", (F.col("v") >= 0).cast("int").alias("y"), F.xxhash64("rk").alias("o")), "labelled")
    drawn = [each.filter(F.col("y") == y).orderBy("o", "rk").limit(sample) for y in (0, 1)]
    drawn = materialise(drawn[0].unionByName(drawn[1]), "drawn")
    whole = rows.join(drawn, "rk").groupBy("rk", "y", "o").agg(F.min("text").alias("text"))

    def hashed(batches: Iterator[dict]):
        grams = Grams()
        for b in batches:
            for k, y, o, t in zip(b["rk"], b["y"], b["o"], b["text"]):
                at = np.unique(grams(t))
                yield k, y, o, len(at), at.tobytes()

    made = materialise(map_rows(whole, hashed, "rk long, y int, o long, n long, at binary", 200), "grams")
    order = sorted((r["o"], r["rk"], r["n"]) for r in made.select("o", "rk", "n").collect())
    left = features - np.cumsum([n for _, _, n in order])
    last = order[int((left >= 0).sum()) - 1] if len(order) and left[0] >= 0 else None
    if last is None:
        return []
    fits = made.filter(F.struct("o", "rk") <= F.struct(F.lit(last[0]), F.lit(last[1]))) if left[-1] < 0 else made
    got = sorted((r["o"], r["rk"], r["y"], bytes(r["at"])) for r in fits.select("o", "rk", "y", "at").collect())
    return [(np.frombuffer(at, np.int32), float(y)) for _, _, y, at in got]


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row.

    The model learns ``labels.toxic`` (0 or 1; others do not count) of documents that are not held out and
    reads nothing but texts. A null or empty text has the intercept's score. Equal texts score alike.
    Without any label all scores are 0.5. A null doc_id is never held out and never learned from.
    An empty table gives an empty table. Other columns do not count.
    """
    at, weights = fit(training_sample(docs, labels, sample))

    def rows(batches: Iterator[dict]):
        scorer = Scorer(at, weights)
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                yield i, scorer(t)

    out = map_rows(texts(docs), rows, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
