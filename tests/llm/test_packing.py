import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from strataflow.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(df, tokenizer, padding):
    got = packing.pack(df).collect()
    want = defaultdict(list)
    for r in df.collect():
        want[r.doc_id].append(ids_of(tokenizer, r.text))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(pieces) == set(want)
    for i, texts in want.items():
        assert sum(p.length for p in pieces[i]) == sum(map(len, texts))
        for p in pieces[i]:
            fits = [t for t in texts if len(t) == p.doc_tokens]
            crcs = {zlib.crc32(np.array(t[p.start : p.start + p.length], "<u4").tobytes()) for t in fits}
            assert p.ids_crc32 in crcs
        if len(texts) == 1:
            at = 0
            for p in sorted(pieces[i], key=lambda p: p.start):
                assert p.start == at and p.length > 0
                at += p.length
            assert at == len(texts[0])
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    total = sum(p.length for p in got)
    assert len(sequences) * 2048 - total <= padding * total + 2048
    return got


def test_every_token_once_and_little_padding(docs, tokenizer):
    check(docs, tokenizer, 0.01)


def test_odd_rows(odd, nothing, tokenizer):
    check(odd, tokenizer, 0.01)
    assert packing.pack(nothing).count() == 0


def test_words_encode_like_whole_texts(tokenizer):
    encode = packing.Encoder(packing.default_tokenizer())
    texts = ["It's  we'll\tI'm\n\n'sx 'd", "é e\u0301 \u0301x", "<|endoftext|> a<|startoftext|>b", "x\u00a0y\u2003z \u0085", "12 3a4 !!?? 𝒳😀", "", " \n ", "İstanbul ΣΑΣ Σ ς", "Than, ÉTÉ été. e\u0301te\u0301, ǅ ª º ß. ﬁ, 中文! ñ; don't: it's.", "x.. , .,", "".join(map(chr, range(0x250)))]
    texts += ["<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "a\u0301<|endoftext|>\u0301\n<|startoftext|><|endoftext|>"]
    texts += [chr(c) + "a. " + "a" + chr(c) + ", " + chr(c) for c in range(0xA0, 0x3000, 7)]
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == ids_of(tokenizer, text)


def test_ids_do_not_depend_on_words_met_before(tokenizer):
    encode = packing.Encoder(packing.default_tokenizer())
    for text in ("σας", "ΣΑΣ", "σασ ΣΑΣ, σας"):
        assert encode([text])[0].tolist() == ids_of(tokenizer, text)


def test_long_texts_are_encoded_by_parts(tokenizer, monkeypatch):
    texts = ["", "one", "Été, don't " * 40 + "<|endoftext|>" + "x" * 150 + " \n\n  y" * 90, " " * 200, "ab\n" * 70, "z" * 300]
    encode = packing.Encoder(packing.default_tokenizer())
    for chars in (1 << 22, 64, 1):
        monkeypatch.setattr(packing, "GROUP_CHARS", chars, raising=False)
        assert [ids.tolist() for ids in encode(texts)] == [ids_of(tokenizer, text) for text in texts]
    assert encode([]) == []


class Counted:
    """A tokenizer, and how often the vocabulary was asked."""

    def __init__(self, tokenizer):
        self.encode_batch, self.asked = tokenizer.encode_batch, 0
        self.inner, self.model = tokenizer.model, self

    def tokenize(self, word):
        self.asked += 1
        return self.inner.tokenize(word)


def test_spellings_of_a_word_share_what_is_remembered(tokenizer):
    encode = packing.Encoder(packing.default_tokenizer(), cache=100)
    encode.tokenizer = counted = Counted(encode.tokenizer)
    words = [a + b for a in "bdfgklmnpr" for b in ("anth", "este", "irol", "orun", "ubal", "ynd")]
    text = " ".join(form for w in words for form in (w, w.title(), w.upper(), w + ",", w.title() + "."))
    for _ in range(3):
        assert encode([text])[0].tolist() == ids_of(tokenizer, text)
    assert counted.asked == len(words)


def test_neighbours_come_by_bm25():
    rng = np.random.default_rng(3)
    topics = [rng.integers(100 * k, 100 * k + 60, 40) for k in range(1, 40)]
    units = [np.concatenate([rng.permutation(t), rng.integers(0, 50, 10)]).astype("<u2") for t in topics for _ in range(40)]
    order = rng.permutation(len(units))
    units = [units[k] for k in order]
    topic = [int(k) // 40 for k in order]
    having = np.zeros(1 << 16)
    for u in units:
        having[np.unique(u)] += 1
    idf = np.log1p((len(units) - having + 0.5) / (having + 0.5)).astype(np.float32)
    index = packing.Index(units, idf, 50.0)
    # Scores are BM25, term by term.
    seed, other = 0, 7
    terms = np.unique(units[seed])
    want = 0.0
    for t in terms:
        f = int((units[other] == t).sum())
        want += idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(units[other]) / 50.0))
    assert abs(index.scores(seed)[other] - want) < 1e-3
    windows = list(packing.pack_units(units, index))
    assert sum(n for w in windows for _, _, n in w) == sum(map(len, units))
    same = [np.mean([topic[u] == topic[w[0][0]] for u, _, _ in w]) for w in windows]
    assert np.mean(same) > 0.9


TOPICS = 40


def topical(spark, tmp_path, name, files):
    """Documents of 40 topics; a window of one topic needs documents from anywhere in the table."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}{d}" for a in "bdfgklmn" for b in "aeiou" for c in "prstvz" for d in ("on", "el", "ix", "um", "as")]
    rows = []
    for k in range(4000):
        topic = k % TOPICS
        own = rng.choice(words[topic * 25 : topic * 25 + 25], 90)
        rows.append((k, " ".join([*own, *rng.choice(words[1000:], 30)])))
    path = str(tmp_path / name)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def windows_of(pieces):
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append((p.offset, p.doc_id, p.start, p.length))
    return sorted(tuple(sorted(w)) for w in held.values())


def test_many_shards_find_the_neighbours_that_one_finds(spark, tmp_path, tokenizer):
    docs = topical(spark, tmp_path, "a", 3)
    share = {}
    for tokens in (1 << 40, 60_000):
        got = windows_of(packing.pack(docs, shard_tokens=tokens).collect())
        share[tokens] = np.mean([np.mean([d % TOPICS == w[0][1] % TOPICS for _, d, _, _ in w]) for w in got])
    assert share[1 << 40] > 0.9 and share[60_000] > share[1 << 40] - 0.02


def test_windows_do_not_depend_on_files(spark, tmp_path):
    one, other = (windows_of(packing.pack(topical(spark, tmp_path, f"f{n}", n), shard_tokens=100_000).collect()) for n in (1, 7))
    assert one == other


def test_a_theme_larger_than_a_shard_is_dealt_out(spark):
    rows = [(k, k % 3, 1) for k in range(900)] + [(1000 + k, 3, k % 50) for k in range(900)] + [(5000 + k, 4 + k % 90, -1) for k in range(900)]
    units = spark.createDataFrame([(r, 100, a, b) for r, a, b in rows], "row long, length long, theme long, second long")
    got = packing.dealt(units, 10_000).groupBy("bucket", "part", "salt").sum("length").collect()
    assert sum(r["sum(length)"] for r in got) == 270_000
    assert max(r["sum(length)"] for r in got) < 40_000 and 20 <= len(got) < 40
    assert {r.part for r in got if r.bucket in (0, 1, 2)} == {1}
