import random
import time

import numpy as np
import pytest

from strataflow.llm import tiling
from strataflow.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_tiles(item, text, least):
    """Greedy string tiling word by word."""
    marked_i, marked_t, found = set(), set(), []
    while True:
        best, places = least - 1, []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in marked_i and j + n not in marked_t:
                    n += 1
                if n > best:
                    best, places = n, [(i, j)]
                elif n == best and n >= least:
                    places.append((i, j))
        if best < least or not places:
            return sorted(found)
        for i, j in places:
            if marked_i.isdisjoint(range(i, i + best)) and marked_t.isdisjoint(range(j, j + best)):
                marked_i |= set(range(i, i + best))
                marked_t |= set(range(j, j + best))
                found.append((i, j, best))


@pytest.mark.parametrize("seed", range(25))
def test_tiles_equal_brute_force(seed):
    rng = random.Random(seed)
    item = [rng.randint(0, 6 + seed) for _ in range(rng.randint(1, 25))]
    text = [rng.randint(0, 6 + seed) for _ in range(rng.randint(0, 30))]
    for _ in range(3):
        a, n = rng.randrange(len(item)), rng.randint(2, 10)
        at = rng.randint(0, len(text))
        text[at:at] = item[a : a + n]
    least = rng.randint(1, 4)
    got = tiling.tiles(np.array(item, np.uint64), np.array(text, np.uint64), least)
    assert sorted(got) == brute_tiles(item, text, least)


def brute(docs, items):
    split = tiling.Words()
    out = {}
    first = {}
    for i, t in items:
        if t is not None:
            first[t] = min(i, first.get(t, i))
    for d, t in docs:
        y = split(t or "")
        for text, i in first.items():
            x = split(text)
            if len(x) and len(np.intersect1d(x, y)):
                n = sum(k for _, _, k in tiling.tiles(x, y, min(tiling.SEED_WORDS, len(x))))
                if n and n >= tiling.COVERAGE * len(x):
                    out[d, i] = n
    return out


def test_equals_comparison_of_all_pairs(spark, texts):
    items = table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id): r.covered_words for r in tiling.contaminated(table(spark, SF, "documents"), items).collect()}
    short = [(i, t) for i, t in texts if len(t) < 6000 or any(i == d for d, _ in got)]
    want = brute(short, [(r.item_id, r.text) for r in items.collect()])
    assert got == want and got


def test_reordered_and_partial_passages(spark, odd, nothing):
    rng = random.Random(4)
    parts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(9)) for _ in range(4)]
    filler = " ".join(f"f{k}" for k in range(300))
    items = spark.createDataFrame([(5, ". ".join(parts), "x"), (3, ". ".join(parts), "y"), (6, "Tiny Item", "z"), (7, "", ""), (8, None, None)], "item_id long, text string, doc_id string")
    rows = [
        (1, f"{filler}. {parts[2]}! {parts[0].upper()}\n{parts[3]}, {parts[1]} {filler}"),
        (2, f"{parts[0]} {filler} {parts[1]}"),
        (3, f"{parts[0]} {filler} {parts[1]} {filler} {parts[3]}"),
        (4, filler),
        (5, "a tiny, item"),
        (6, None),
    ]
    got = tiling.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in got} == {(1, 3, 4, 1.0), (3, 3, 3, 0.75), (5, 6, 1, 1.0)}
    assert tiling.contaminated(nothing, items).count() == 0
    assert tiling.contaminated(odd, items.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "six seven eight nine ten one two")], "item_id long, text string")
    hit = tiling.contaminated(odd, one).collect()
    assert {r.doc_id for r in hit} == {4, None} and len(hit) == 2
    left = tiling.drop_contaminated(odd, one)
    assert left.columns == odd.columns and left.count() == odd.count() - 4


def test_hashes_of_runs_equal_those_of_seeds():
    words = np.random.default_rng(1).integers(0, 1 << 64, 400, np.uint64)
    runs = tiling.Runs(words)
    for size in (1, 2, 5, 77, 400):
        at, h = runs.unmarked(np.ones(400, bool), size)
        assert at.tolist() == list(range(401 - size)) and np.array_equal(h, tiling.rolling(words, size))
    assert len(runs.unmarked(np.ones(400, bool), 401)[0]) == 0
    assert tiling.tiles(words[:0], words, 1) == tiling.tiles(words, words[:0], 1) == []


@pytest.mark.parametrize("seed", range(8))
def test_repetitive_texts_equal_brute_force(seed):
    rng = random.Random(seed)
    item, text = ([rng.choice((1, 1, 1, 2)) for _ in range(n)] for n in (rng.randint(1, 18), rng.randint(1, 22)))
    got = tiling.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 1 + seed % 4)
    assert sorted(got) == brute_tiles(item, text, 1 + seed % 4)


def test_long_and_repetitive_texts_do_not_cost_a_square():
    """Ten times 2,000 words against 8,000 of them, of one word or of a phrase that repeats."""
    start = time.process_time()
    for period in (1, 7, 50):
        item, text = (np.arange(n, dtype=np.uint64) % np.uint64(period) for n in (20_000, 80_000))
        assert sum(n for _, _, n in tiling.tiles(item, text, 5)) == 20_000
    assert time.process_time() - start < 20


def test_a_long_item_is_no_part_of_its_seeds(spark):
    words = [f"w{k}" for k in range(20_000)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    moved = words[9_000:] + ["else"] + words[:5_000]
    docs = spark.createDataFrame([(1, " ".join(moved)), (2, " ".join(words[:9_000]))], "doc_id long, text string")
    got = tiling.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_words, r.covered_words, r.n_tiles) for r in got] == [(1, 20_000, 16_000, 2)]
