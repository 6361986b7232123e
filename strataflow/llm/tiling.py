"""Benchmark decontamination by greedy string tiling of documents with benchmark items."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import bit_filter, map_rows, passes, text_key, texts

SEED_WORDS = 5
COVERAGE = 0.6
CACHE = 100_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Words:
    """Word hashes of a text: runs of letters and digits, ASCII lower-cased; the rest separates."""

    TABLE = bytes(
        c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
    )

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        w = text.encode().translate(self.TABLE).split()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        known.update((x, xxhash.xxh64_intdigest(x)) for x in set(w).difference(known))
        return np.fromiter(map(known.__getitem__, w), np.uint64, len(w))


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` words, modulo 2^64."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out = out * BASE + words[i : i + n]
    return out


class Runs:
    """Karp-Rabin hashes of the runs of a word sequence, of any length, from one pass over it.

    The base is odd, so it has an inverse modulo 2^64: with sums of word * base^-place, the hash of a run
    is a difference of two sums times a power of the base.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = words
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * inverse[:n], dtype=np.uint64)])

    def unmarked(self, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of ``size`` free words."""
        if len(self.words) < size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        taken = np.cumsum(np.concatenate([[0], ~free]))
        at = np.flatnonzero(taken[size:] == taken[:-size])
        return at, self.power[at + size - 1] * (self.sums[at + size] - self.sums[at])


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, words), each word in one tile at most.

    The longest common run of unmarked words is marked first, ties by place in the item, then in the
    text; runs shorter than ``least`` do not count.

    Per length, runs of equal hash are gone through once: a run that a tile has touched stays
    touched, so repetitive texts do not cost a comparison for each two of their runs.
    """
    found = []
    x, y = Runs(item), Runs(text)
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    # Only a text word that the item has can be in a tile.
    free_text &= np.isin(text, item)
    size = _longest(x, y, free_item, free_text, least, len(item))
    while size >= least:
        at_item, groups = _common(x, y, free_item, free_text, size)
        for i, h in at_item:
            # All tiles of this round are as long as the run: one that overlaps it covers an end of it.
            if not (free_item[i] and free_item[i + size - 1]):
                continue
            left = groups[h]
            while left and not (free_text[left[-1]] and free_text[left[-1] + size - 1]):
                left.pop()
            for j in reversed(left):
                if free_text[j] and free_text[j + size - 1] and np.array_equal(item[i : i + size], text[j : j + size]):
                    found.append((i, j, size))
                    free_item[i : i + size] = False
                    free_text[j : j + size] = False
                    break
        size = _longest(x, y, free_item, free_text, least, size - 1)
    return found


def _longest(x: Runs, y: Runs, free_item, free_text, least: int, most: int) -> int:
    """Length of the longest common unmarked run, by bisection: a common run has common shorter runs. 0: none."""

    def common(size: int) -> bool:
        at_item, groups = _common(x, y, free_item, free_text, size)
        return any(
            np.array_equal(x.words[i : i + size], y.words[j : j + size]) for i, h in at_item for j in reversed(groups[h])
        )

    if most < least or not common(least):
        return 0
    low, high = least, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if common(middle) else (low, middle - 1)
    return low


def _common(x: Runs, y: Runs, free_item, free_text, size: int) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
    """Runs whose hash both sides have: (place, hash) in the item by place, and places in the text by hash, last first."""
    at_i, h_i = x.unmarked(free_item, size)
    at_j, h_j = y.unmarked(free_text, size)
    in_text, in_item = np.isin(h_i, h_j), np.isin(h_j, h_i)
    groups: dict[int, list[int]] = {}
    for j, h in zip(at_j[in_item][::-1].tolist(), h_j[in_item][::-1].tolist()):
        groups.setdefault(h, []).append(j)
    return list(zip(at_i[in_text].tolist(), h_i[in_text].tolist())), groups


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, words: int = SEED_WORDS) -> DataFrame:
    """``doc_id``, ``rk``, ``item_id``, ``item_words``, ``covered_words``, ``coverage``, ``n_tiles`` of each document
    and benchmark item whose tiles cover at least the given share of the item's words.

    Passages whose parts were moved are found, as tiles may come in any order. Items shorter than
    ``words`` words are one seed and one tile. Null and empty texts, and items without words, match nothing.
    Equal item texts are one item, named by the smallest item_id. Rows equal in doc_id and text are one document.

    Seeds are hashes of ``words`` successive words. Documents are read once; only those that hold a seed
    go on, past a bit table of bounded size, with their text. They meet the items by an equality join on the
    seed, and pairs whose seeds cannot cover enough are dropped before any text is compared.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).filter("text is not null")
    items = materialise(items.groupBy("text").agg(F.min("item_id").alias("item_id")), "items")

    def seeds_of(batches: Iterator[dict]):
        split = Words()
        for b in batches:
            for i, t in zip(b["item_id"], b["text"]):
                w = split(t)
                size = min(words, len(w))
                if size:
                    for at, h in enumerate(rolling(w, size).astype(np.int64).tolist()):
                        yield h, i, len(w), size, at

    seeds = materialise(
        map_rows(items, seeds_of, "h long, item_id long, item_words int, size int, at int"), "seeds"
    )
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())
    bits = spark.sparkContext.broadcast(bit_filter(seeds.select("h").distinct()))

    def seeded(batches: Iterator[dict]):
        split = Words()
        for b in batches:
            for i, k, t in zip(b["doc_id"], b["rk"], b["text"]):
                w = split(t)
                h = np.concatenate([np.empty(0, np.uint64), *(rolling(w, s) for s in sizes)])
                h = h[passes(bits.value, h)]
                if len(h):
                    yield i, k, t, np.unique(h).view(np.int64).tolist()

    read = texts(docs).withColumn("rk", text_key())
    hits = materialise(map_rows(read, seeded, "doc_id long, rk long, text string, seeds array<long>", 200), "seeded")
    places = seeds.select("h", "item_id", "item_words", "size", "at")
    met = hits.select("doc_id", "rk", F.explode("seeds").alias("h")).distinct().join(places, "h")
    # Each seed covers at most its own words, so seeds of a pair bound what tiles can cover.
    pairs = met.groupBy("doc_id", "rk", "item_id", "item_words").agg(F.sum("size").alias("most"))
    pairs = pairs.filter(F.col("most") >= coverage * F.col("item_words")).select("doc_id", "rk", "item_id")
    whole = items.select("item_id", F.col("text").alias("item"))
    same = F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.rk") == F.col("t.rk"))
    once = hits.select("doc_id", "rk", "text").distinct()
    both = pairs.alias("p").join(whole, "item_id").alias("p").join(once.alias("t"), same)
    both = both.select("p.doc_id", "p.rk", "p.item_id", "p.item", "t.text")

    def tiled(batches: Iterator[dict]):
        split = Words()
        for b in batches:
            for i, k, item, a, t in zip(b["doc_id"], b["rk"], b["item_id"], b["item"], b["text"]):
                x, y = split(a), split(t)
                found = tiles(x, y, min(words, len(x)))
                covered = sum(n for _, _, n in found)
                if found and covered >= coverage * len(x):
                    yield i, k, item, len(x), covered, covered / len(x), len(found)

    schema = "doc_id long, rk long, item_id long, item_words int, covered_words int, coverage double, n_tiles int"
    return map_rows(both, tiled, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; the columns stay as they are."""
    bad = contaminated(docs, benchmark, coverage).select(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk")).distinct()
    bad = materialise(bad, "contaminated")
    here = docs.withColumn("__key", text_key())
    same = here["doc_id"].cast("long").eqNullSafe(bad["__id"]) & (here["__key"] == bad["__rk"])
    return here.join(bad, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
