import re

import pytest
from brute import LOWER

from strataflow.llm import licenses

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def expected(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def rows_of(df):
    return sorted(
        ((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.collect()), key=str
    )


def test_base_places_equal_brute_force(spark, docs, texts, odd):
    want = lambda rows: sorted(((str(i), *expected(t)) for i, t in rows), key=str)
    assert rows_of(licenses.scan(docs)) == want(texts)
    more = [(1, "CC BY cc-by CC\nBY.NC"), (2, "x All rights  reserved all-rights-reserved rights reserved"), (3, "GNU General Public License, general public licenses ccby cc é by")]
    for df in (odd, spark.createDataFrame(more, "doc_id long, text string")):
        got = licenses.scan(df)
        assert rows_of(got) == want([(r.doc_id, r.text) for r in df.collect()])
        for r in got.collect():
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize(
    "value,labels,free",
    [
        ("MIT", {"mit"}, True),
        ("MIT OR Apache-2.0", {"mit", "apache"}, True),
        ("LicenseRef-own AND MIT", {"other", "mit"}, False),
        ("LicenseRef-own OR MIT AND BSD-3-Clause", {"other", "mit", "bsd"}, True),
        ("(LicenseRef-own OR MIT) AND GPL-2.0-only WITH Classpath-exception-2.0", {"other", "mit", "gpl"}, True),
        ("CC-BY-NC-4.0 and then prose goes on", {"cc-by-nc", "other"}, False),
        ("cc0-1.0 */ int main", {"public-domain"}, True),
    ],
)
def test_expressions(value, labels, free):
    assert licenses.evaluate(licenses.leading_expression(value)) == (labels, free)


@pytest.mark.parametrize("value", ["AND MIT", "", "( MIT", ")", "OR"])
def test_what_is_no_expression(value):
    assert not licenses.leading_expression(value)


def test_tags_and_notices(spark, nothing):
    rows = [(1, "// SPDX-License-Identifier: MIT OR GPL-2.0+\ncode"), (2, "Licensed under the Apache License, Version 2.0."), (3, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "gpl,mit" and got[1].open_terms and got[1].score == 1.0
    assert got[2].labels == "apache" and got[3].labels == "cc-by,cc-by-nc"
    assert licenses.scan(nothing).count() == 0
