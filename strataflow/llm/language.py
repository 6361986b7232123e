"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of fixed length, the largest response
of each filter feeds a softmax. Training is numpy on a bounded sample; a whole text is covered by
consecutive windows, and what the windows say is averaged.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 6
SAMPLE_PER_LANGUAGE = 1500  # windows; the bound of the training sample
SAMPLE = 60_000  # windows of all languages together
UNKNOWN = "und"


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32 of the number as text leaves 1 when divided by 3; a null number is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


# ---- The network ------------------------------------------------------------------------------


def _responses(net: dict, x: np.ndarray) -> list[np.ndarray]:
    """Of each width: windows x positions x filters."""
    out = []
    for w in WIDTHS:
        weight = net[f"w{w}"]
        n = x.shape[1] - w + 1
        embedded = net["e"][x]
        r = sum(embedded[:, i : i + n] @ weight[i] for i in range(w))
        out.append(r + net[f"b{w}"])
    return out


def train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 14, rate: float = 0.01) -> dict:
    """Adam on the cross entropy; x: windows of bytes (0 pads), y: class numbers."""
    rng = np.random.Generator(np.random.PCG64(11))
    pooled = len(WIDTHS) * FILTERS
    net = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "u": rng.normal(0, 0.1, (pooled, classes)), "c": np.zeros(classes)}
    for w in WIDTHS:
        net[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS))
        net[f"b{w}"] = np.zeros(FILTERS)
    net = {k: v.astype(np.float32) for k, v in net.items()}
    mean = {k: np.zeros_like(v) for k, v in net.items()}
    square = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            grad = _gradient(net, x[rows], y[rows])
            step += 1
            for k, g in grad.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                m, s = mean[k] / (1 - 0.9**step), square[k] / (1 - 0.999**step)
                net[k] -= rate * m / (np.sqrt(s) + 1e-7)
    return net


def _gradient(net: dict, x: np.ndarray, y: np.ndarray) -> dict:
    responses = _responses(net, x)
    best = [r.argmax(1) for r in responses]
    top = [np.take_along_axis(r, b[:, None], 1)[:, 0] for r, b in zip(responses, best)]
    hidden = np.concatenate(top, 1)
    active = np.maximum(hidden, 0)
    p = _softmax(active @ net["u"] + net["c"])
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    grad["u"], grad["c"] = active.T @ p, p.sum(0)
    back = (p @ net["u"].T) * (hidden > 0)
    rows = np.arange(len(x))[:, None]
    for k, w in enumerate(WIDTHS):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        grad[f"b{w}"] = g.sum(0)
        for i in range(w):
            seen = x[rows, best[k] + i]  # windows x filters: the byte each filter saw
            emb = net["e"][seen]
            grad[f"w{w}"][i] = np.einsum("nf,nfe->ef", g, emb)
            np.add.at(grad["e"], seen, g[:, :, None] * net[f"w{w}"][i].T[None])
    return grad


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class Scorer:
    """The trained network as lookup tables: a filter's response is a sum of one entry per byte it covers."""

    def __init__(self, net: dict):
        self.net = net
        self.one = {(w, i): net["e"] @ net[f"w{w}"][i] for w in WIDTHS for i in range(w)}
        # Entries of two neighbouring bytes, added up beforehand.
        self.two = {
            (w, i): (self.one[w, i][:, None] + self.one[w, i + 1][None]).reshape(65536, FILTERS)
            for w in WIDTHS
            for i in range(0, w - 1, 2)
        }

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Class probabilities of each window."""
        wide = windows.astype(np.int64)
        pair = wide[:, :-1] * 256 + wide[:, 1:]
        hidden = []
        for w in WIDTHS:
            n = windows.shape[1] - w + 1
            r = None
            for i in range(0, w, 2):
                part = self.two[w, i].take(pair[:, i : i + n], 0) if i + 1 < w else self.one[w, i].take(wide[:, i : i + n], 0)
                r = part if r is None else np.add(r, part, out=r)
            hidden.append(r.max(1) + self.net[f"b{w}"])
        active = np.maximum(np.concatenate(hidden, 1), 0)
        return _softmax(active @ self.net["u"] + self.net["c"])


def windows_of(raw: bytes) -> np.ndarray:
    """Consecutive windows over all bytes; the last is filled with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


# ---- Spark ------------------------------------------------------------------------------------


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, seed: str = "w", windows: int = SAMPLE):
    """Windows and class numbers of at most ``per_language`` distinct texts of each language, one window of each.

    Every language has a class. With many of them each gets fewer texts, so that all together are ``windows`` at most (one of
    each language at least). The texts are those whose hash falls below a share set from the exact count of distinct
    texts of their language, so the sample spreads over the whole table and a text counts once, however
    many rows repeat it. The window is a place in the text that the text's hash chooses.
    """
    drawn_by = F.xxhash64(F.lit(seed), "text")
    labelled = (
        docs.select("doc_id", F.col("lang").cast("string"), "text")
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    )
    counts = labelled.groupBy("lang").agg(F.count_distinct(drawn_by).alias("n"))
    counts = materialise(counts, "languages")
    names = sorted(r["lang"] for r in counts.select("lang").collect())
    if not names:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    each = max(1, min(per_language, windows // len(names)))
    # Some more than wanted, so that chance leaves no language short; the first by hash are taken. All, if few.
    share = F.lit(each + 6 * each**0.5 + 20) / F.col("n")
    n = F.length("text")
    start = F.pmod(F.xxhash64("text", F.lit(seed)), F.greatest(n - WINDOW + 1, F.lit(1))) + 1
    cut = labelled.select("lang", drawn_by.alias("o"), F.substr("text", start.cast("int"), F.lit(WINDOW)).alias("w"))
    near = cut.join(counts, "lang").filter(F.pmod("o", F.lit(1 << 40)) / F.lit(float(1 << 40)) < share)
    texts_of = near.groupBy("lang", "o").agg(F.min("w").alias("w"))
    got = texts_of.select("lang", F.pmod("o", F.lit(1 << 40)).alias("o"), "w").toArrow().sort_by([(c, "ascending") for c in ("lang", "o", "w")])
    order: list[tuple[str, str]] = []
    taken: dict[str, int] = {}
    for lang, w in zip(got["lang"].to_pylist(), got["w"].to_pylist()):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= each:
            order.append((lang, w))
    order.sort()
    x = np.concatenate([windows_of(w.encode()[:WINDOW]) for _, w in order])
    number = {name: k for k, name in enumerate(names)}
    return names, x, np.array([number[name] for name, _ in order], np.int64)


def detect(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row.

    The network learns from text and lang of rows that are not held out and have both; the prediction
    reads the text only. ``score`` is the mean probability of the predicted language over the text's windows. A null
    text, a text without any letter, and every text if nothing could be learned: ``und``, score 0.
    Equal texts get equal answers; ties go to the first language by name.
    """
    names, x, y = training_sample(docs, per_language)
    net = train(x, y, len(names)) if len(x) else None

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = Scorer(net) if net else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _predict(part["doc_id"], part["text"].to_pylist(), scorer, names)

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predict(ids, batch: list, scorer, names: list[str]) -> pa.RecordBatch:
    kept = [k for k, t in enumerate(batch) if scorer and t and has_letter(t)]
    pieces = [windows_of(batch[k].encode()) for k in kept]
    langs, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
    if pieces:
        sizes = [len(p) for p in pieces]
        windows = np.concatenate(pieces)
        p = np.concatenate([scorer.probabilities(windows[i : i + 64]) for i in range(0, len(windows), 64)])
        sums = np.add.reduceat(p.astype(np.float64), np.cumsum([0, *sizes[:-1]]))
        for k, total, n in zip(kept, sums, sizes):
            best = int(total.argmax())
            langs[k], scores[k] = names[best], float(min(1.0, total[best] / n))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
    )


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Rows whose language is identified with at least ``least``; all columns as they are.

    Texts of ``und`` and texts whose windows do not agree on a language go.
    """
    names, x, y = training_sample(docs)
    net = train(x, y, len(names)) if len(x) else None
    state: dict = {}

    @F.arrow_udf("boolean")
    def identified(batch: pa.Array) -> pa.Array:
        if "scorer" not in state:
            state["scorer"] = Scorer(net) if net else None
        out: list[bool] = []
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256).to_pylist()
            got = _predict(pa.nulls(len(part)), part, state["scorer"], names)
            pairs = zip(got["lang_pred"].to_pylist(), got["score"].to_pylist())
            out += [lang != UNKNOWN and s >= least for lang, s in pairs]
        return pa.array(out, pa.bool_())

    return docs.filter(identified("text"))
