import random

import numpy as np

from strataflow.llm import weak_labels


def test_em_recovers_accuracies():
    rng = random.Random(1)
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.6, 0.75, 0.8]
    counts, truth = {}, {}
    for _ in range(20_000):
        good = rng.random() < 0.7
        p = "".join("0" if rng.random() < 0.3 else "+" if good == (rng.random() < a) else "-" for a in accuracy)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(good)
    prior, rates, good = weak_labels.estimate(sorted(counts), [counts[p] for p in sorted(counts)])
    assert abs(prior - 0.7) < 0.03
    for k, a in enumerate(accuracy):
        right = rates[1, k, 2] / (rates[1, k, 2] + rates[1, k, 0])
        assert abs(right - a) < 0.05
    hits = sum((good[p] >= 0.5) == g for p, gs in truth.items() for g in gs)
    assert hits / 20_000 > 0.94


def test_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in weak_labels.classify(docs).collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    kept_good = np.mean([got[r.doc_id].keep for r in labels if r.quality == 1])
    kept_bad = np.mean([got[r.doc_id].keep for r in labels if r.quality == 0])
    assert kept_good > 0.98 and kept_bad < 0.15


def test_odd_rows(odd, nothing):
    got = weak_labels.classify(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        assert 0 <= r.score <= 1
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].score == 0.0 and not by[i][0].keep for i in (1, 2, 3))
    assert by[7][0].score == by[8][0].score
    assert weak_labels.classify(nothing).count() == 0


def test_copies_do_not_fill_the_sample(spark):
    rows = [(k, "the same words again and again" if k % 2 else f"some text {k} of many") for k in range(6000)]
    read = weak_labels.texts(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("rk", weak_labels.text_key())
    got = weak_labels.distinct_sample(read, 3001, 1000).collect()
    assert 1000 <= len(got) < 1500 and len({r.text for r in got}) == len(got)
    assert weak_labels.distinct_sample(read, 3001, 5000).count() == 3001


def test_scores_are_those_of_a_plain_version(spark, docs, texts):
    """Votes, posteriors and scores of every row, computed without Spark."""
    got = {r.doc_id: r for r in weak_labels.classify(docs).collect()}
    said = {i: weak_labels.votes(t or "") for i, t in texts}
    counts = {}
    for v in said.values():
        counts[v] = counts.get(v, 0) + 1
    _, _, good = weak_labels.estimate(sorted(counts), [counts[v] for v in sorted(counts)])
    distinct = sorted({t or "" for _, t in texts})
    assert len(distinct) <= weak_labels.SAMPLE
    vector = weak_labels.Hasher()
    x = np.array([vector(t) for t in distinct])
    w, b = weak_labels.fit(x, np.array([good[weak_labels.votes(t)] for t in distinct], np.float32))
    for i, t in texts:
        x = vector(t or "")
        want = 1 / (1 + np.exp(-float(x @ w) - b)) if x.any() else 0.0
        assert abs(got[i].score - want) < 0.02
        assert abs(want - 0.5) < 0.02 or got[i].keep == (want >= 0.5)
