import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import toxicity
from strataflow.llm.toxicity import Ftrl, Grams, Scorer, fit, score, training_sample

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(got) == docs.count()
    held = {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {i for i, r in got.items() if r.held_out} == held
    known = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if r.doc_id in held]
    s, y = np.array(known).T
    area = np.mean(s[y == 1][:, None] > s[y == 0])
    assert area > 0.95 and np.mean(s[y == 0] >= 0.7) < 0.02 and np.mean(s[y == 1] >= 0.7) > 0.6
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def test_only_texts_and_labels_of_others_decide(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = sorted(score(docs, labels).collect())
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "toxic": F.lit(1)})
    assert sorted(score(other, turned).collect()) == want


def plain_ftrl(examples, alpha, beta, l1, l2):
    """One coordinate at a time, as the update is written in the paper."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)

    for at, y in examples:
        p = 1 / (1 + np.exp(-sum(weight(i) for i in at)))
        for i in at:
            g, w = p - y, weight(i)
            sigma = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / alpha
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w, n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_updates_equal_a_plain_version():
    rng = np.random.default_rng(1)
    examples = [(np.unique(rng.integers(0, 40, 12)), float(rng.integers(0, 2))) for _ in range(300)]
    model = Ftrl(40, 0.5, 1.0, 0.7, 0.1)
    for at, y in examples:
        model.learn(at, y)
    want = plain_ftrl(examples, 0.5, 1.0, 0.7, 0.1)
    assert np.allclose(model.weights(), [want[i] for i in range(40)], atol=1e-12)
    assert 0 < np.count_nonzero(model.weights()) < 40


def test_grams_are_words_pairs_and_skips():
    places = lambda text: sorted(Grams()(text).tolist())
    assert len(places("A b, c d")) == 4 + 3 + 2
    assert places("A b, c d") == places("a B\nC--d") != places("a c b d")
    assert set(places("x y")) - set(places("x")) - set(places("y")) != set()
    assert places("") == places(" .,") == []


def test_scorer_equals_a_plain_sum(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    at, w = fit(training_sample(docs, labels))
    by = dict(zip(at.tolist(), w.tolist()))
    got = {r.doc_id: r.score for r in score(docs, labels).collect()}
    for r in docs.limit(60).collect():
        z = by.get(1 << toxicity.BITS, 0.0) + sum(by.get(i, 0.0) for i in set(Grams()(r.text or "").tolist()))
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def test_sample_is_bounded_under_copies(spark):
    """Half of all rows are one text; the sample holds each text once, at most as many as asked."""
    rows = [(i, "the one text" if i % 2 else f"text number {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = training_sample(docs, labels, 100)
    assert len(got) == 200 and sum(y for _, y in got) == 100
    learned = {t for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(training_sample(docs, labels, 10**6)) == len(learned)
    few = training_sample(docs, labels, 100, features=300)
    assert 0 < sum(len(a) for a, _ in few) <= 300


def test_odd_rows(spark, odd, nothing):
    schema = "doc_id long, toxic int, text string, rk string, y int, v int"
    labels = [(4, 1), (7, 0), (9, 1), (9, None), (10, 5), (None, 1), (11, 0), (11, 1), (77, 1)]
    labels = spark.createDataFrame([(i, t, "", "", 0, 0) for i, t in labels], schema)
    got = score(odd, labels).collect()
    assert len(got) == odd.count()
    by = {}
    for r, text in zip(got, [r.text for r in odd.collect()]):
        by.setdefault(text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert score(nothing, labels).count() == 0
    assert {r.score for r in score(odd, labels.limit(0)).collect()} == {0.5}


def test_empty_texts_have_the_score_of_the_intercept():
    s = Scorer(np.array([1 << toxicity.BITS], np.int32), np.array([-1.0]))
    assert s("") == pytest.approx(1 / (1 + np.e))
