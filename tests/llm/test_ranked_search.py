import math
import re
from collections import Counter

import numpy as np
import pytest

from strataflow.llm import ranked_search
from strataflow.llm.ranked_search import Treap, ranked, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    words = [(i, plain_terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    counts = [(i, len(w), Counter(w)) for i, w in words]
    out = []
    for item_id, text in items:
        scored = [0] * len(counts)
        for term, times in Counter(plain_terms(text)).items():
            df = sum(term in c for *_, c in counts)
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            for k_, (_, n, c) in enumerate(counts):
                if term in c:
                    m = 100 - 25 + 25 * n * n_docs // total
                    scored[k_] += times * w * (1_000_000_000 * c[term] // (1000 * c[term] + 12 * m))
        best = sorted((-s, i is None, i or 0, i) for s, (i, *_) in zip(scored, counts) if s > 0)[:k]
        out += [(item_id, n, b[3], -b[0]) for n, b in enumerate(best, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("n_rows, columns, points", [(1, 1, 1), (3, 5, 6), (100, 50, 400), (700, 900, 20_000), (40, 5000, 9000)])
@pytest.mark.parametrize("frontier", [1 << 22, 1])
def test_treap_equals_the_matrix(monkeypatch, n_rows, columns, points, frontier):
    """Also with many ties, and where the waiting ranges outgrow their bound."""
    monkeypatch.setattr(ranked_search, "FRONTIER", frontier)
    monkeypatch.setattr(ranked_search, "OPEN", 64 if frontier > 1 else 2)
    rng = np.random.default_rng(points)
    at = np.unique(rng.integers(0, n_rows * columns, points))
    values = rng.integers(1, 5, len(at))
    matrix = np.zeros(n_rows * columns, np.int64)
    matrix[at] = values
    matrix = matrix.reshape(n_rows, columns)
    grid = Treap(at // columns, at % columns, values)
    for _ in range(10):
        rows = rng.choice(n_rows, min(n_rows, int(rng.integers(1, 30))), replace=False)
        weights = rng.integers(1, 4, len(rows))
        scores = weights @ matrix[rows]
        want = sorted((-s, c) for c, s in enumerate(scores.tolist()) if s > 0)[:20]
        assert grid.best(rows, weights, 20) == [(-s, c) for s, c in want]


def test_good_ranges_are_opened_and_others_are_not(monkeypatch):
    rng = np.random.default_rng(3)
    at = np.unique(rng.integers(0, 64 * 8192, 100_000))
    grid = Treap(at // 8192, at % 8192, rng.integers(1, 50, len(at)) + 1000 * (at % 8192 < 40))
    steps = []
    step = Treap._step
    monkeypatch.setattr(Treap, "_step", lambda self, node, *a: steps.append(len(node)) or step(self, node, *a))
    grid.best(np.arange(8), np.ones(8, np.int64), 5)
    assert sum(steps) / 2 < 0.15 * 8192


def test_terms():
    odd = "A-b\x00C\x7fd É_ß 1a\x0b𝒳y İ'ſ"
    assert [t.decode() for t in terms(odd)] == plain_terms(odd)
    assert terms(None) == terms("") == terms(" .-_\x00") == []


def test_equals_brute_force(spark, docs, texts, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute(texts, [(r.item_id, r.text) for r in items.collect()])
    assert found(ranked(docs, items)) == want
    # Several shards, and items in several passes.
    monkeypatch.setattr(ranked_search, "SHARD", 500)
    monkeypatch.setattr(ranked_search, "ITEM_CHARS", 3000)
    assert found(ranked(docs.repartition(3), items)) == want


def test_odd_rows(spark, odd, nothing):
    items = [(1, "one TWO two word3x3"), (1, "one TWO two word3x3"), (2, None), (3, ""), (None, "a nine"), (4, "nowhere-to-be-found"), (5, "ünïcödé 𝒳 123")]
    table = spark.createDataFrame([(i, t, 0, "r") for i, t in items], "item_id long, text string, doc_id int, rank string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(ranked(odd, table)) == brute(rows, items)
    assert ranked(nothing, table).count() == 0
    assert ranked(odd, table.limit(0)).count() == 0
