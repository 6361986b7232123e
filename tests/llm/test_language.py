import zlib

import numpy as np

from strataflow.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.detect(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert set(got) == {r.doc_id for r in rows}
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {r.doc_id for r in out}
    right = [got[r.doc_id].lang_pred == r.lang for r in out if got[r.doc_id].lang_pred != "und"]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_texts_decide(spark, docs):
    """What lang says of held-out rows, and other columns, change nothing."""
    from pyspark.sql import functions as F

    a = sorted(language.detect(docs).collect())
    changed = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert sorted(language.detect(changed).collect()) == a


def test_odd_rows(odd, nothing):
    got = language.detect(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 10):
        assert by[i].lang_pred == "und" and by[i].score == 0.0
    assert by[7].lang_pred == by[8].lang_pred != "und"
    assert not by[None].held_out
    assert language.detect(nothing).count() == 0
    assert language.keep_identified(odd).columns == odd.columns
    kept = [r.doc_id for r in language.keep_identified(odd, 0.0).collect()]
    assert not {1, 2, 3, 10} & set(kept) and {7, 8, 9} <= set(kept)


def test_copies_do_not_fill_the_sample(spark):
    """Half of all rows are one text: it is one example, and the bound holds."""
    rows = [(k, "the same words again and again" if k % 2 else f"some text {k} of many", "en") for k in range(6000)]
    names, x, y = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 500)
    assert names == ["en"] and len(x) == len(y) == 500
    assert len(np.unique(x, axis=0)) == 500
    learned = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    names, x, y = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5000)
    assert len(x) == len(learned)


def test_every_language_has_a_class(spark):
    """300 languages, each with characters of its own."""
    rows, at = [], 0
    for k in range(300):
        for n in range(6):
            rows.append((at, chr(0x4E00 + 7 * k) * (20 + n) + " " + chr(0x4E00 + 7 * k + 1) * 9, f"l{k:03d}"))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = sorted({lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1})
    assert len(learned) > 290
    names, x, y = language.training_sample(docs, 4)
    assert names == learned and set(y) == set(range(len(names))) and np.bincount(y).max() <= 4
    names, x, y = language.training_sample(docs, 4, windows=600)
    assert names == learned and np.bincount(y).min() >= 1 and len(x) <= 600


def test_lookup_tables_equal_the_network():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (30, language.WINDOW)).astype(np.uint8)
    net = language.train(x, rng.integers(0, 3, 30), 3, epochs=1)
    hidden = np.maximum(np.concatenate([r.max(1) for r in language._responses(net, x)], 1), 0)
    want = language._softmax(hidden @ net["u"] + net["c"])
    assert np.allclose(language.Scorer(net).probabilities(x), want, atol=1e-5)


def test_gradient():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (5, 24)).astype(np.uint8), rng.integers(0, 3, 5)
    net = {k: v.astype(np.float64) for k, v in language.train(x, y, 3, epochs=1).items()}

    def loss():
        hidden = np.maximum(np.concatenate([r.max(1) for r in language._responses(net, x)], 1), 0)
        return -np.log(language._softmax(hidden @ net["u"] + net["c"])[np.arange(5), y]).mean()

    grad = language._gradient(net, x, y)
    for k, g in grad.items():
        for at in rng.integers(0, g.size, 6):
            at = np.unravel_index(at, g.shape)
            kept, net[k][at] = net[k][at], net[k][at] + 1e-6
            up = loss()
            net[k][at] = kept - 1e-6
            down = loss()
            net[k][at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4
