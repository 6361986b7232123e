import pytest

SF = "/root/testdata/sf0.001"
FULL = "doc_id long, text string, lang string, source string, n_chars long, rk string, key int, first string, h long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    """doc_id and text of every row."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names clash."""
    passage = "one two three four five six seven eight nine ten\n" * 12
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, "", "en", "s"),
        (2, None, "en", "s"),
        (3, " \t\n\n ", None, None),
        (4, passage, "de", "s"),
        (4, passage, "de", "s"),
        (4, passage, "de", "t"),
        (4, "another text under the same number, all rights reserved.", "en", "s"),
        (None, passage, None, None),
        (None, None, None, None),
        (None, "no number here, but SPDX-License-Identifier: MIT AND (Apache-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0)", "en", "s"),
        (7, long, "en", "s"),
        (8, long, "en", "s"),
        (9, "Ünïcödé 𝒳 — 123 \U0001f600 password=\"abcdefgh1\" token: x", "fr", "s"),
        (10, "12345 67890 !!", "fr", "s"),
        (11, "a", "es", "s"),
    ]
    full = [(i, t, lang, s, len(t or ""), "x", 1, "y", 2) for i, t, lang, s in rows]
    return spark.createDataFrame(full, FULL)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], FULL)
