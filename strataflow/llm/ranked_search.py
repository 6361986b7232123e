"""Ranked lexical search in K2-treaps: quadtrees over the grid of terms and documents that keep impact maxima.

Documents are dealt into shards. A shard's grid has a row per term and a column per document; a quadtree
cell that holds any occurrence is one bit, and keeps how far its greatest impact lies below its
parent's. A query walks down the paths of all its rows at once: a range of documents is bounded by the
sum of its rows' cells, the best range is opened first, and a range below the k-th document found is never opened.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import materialise
from .common import texts

SHARD = 1 << 21  # occurrences (term and document) of a shard's grid, about
ITEM_CHARS = 4_000_000  # of the queries that are searched for in one pass, about
OPEN = 64  # ranges opened together
FRONTIER = 1 << 22  # cells of waiting ranges; beyond it the walk goes depth first
BEST = 20

# Letters and digits of ASCII in lower case and all bytes beyond it make terms; the rest parts them.
_PARTS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def terms(text: str | None) -> list[bytes]:
    """Whole runs of ASCII letters and digits and of characters beyond ASCII; only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PARTS).split()


# ---- The grid -------------------------------------------------------------------------------------


def _spread(x: np.ndarray) -> np.ndarray:
    """A zero bit after each bit of numbers below 2^31."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """Quadtree of a grid. Nodes count from the root level by level; the i-th set bit is node i.

    The four bits of node p stand at 4 p; so a child's number is the number of bits set up to its own.
    ``below`` holds, for each node but the root, its parent's maximum less its own. Rows are spread
    over the height, so that cells part by row in the upper levels and by document only further down.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray):
        size = int(columns.max()) + 1
        row_bits = int(rows.max()).bit_length()
        self.height = max(row_bits, (size - 1).bit_length(), 1)
        self.shift = self.height - row_bits
        code = (_spread(rows << self.shift) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code)
        here, top = code[order], impacts[order].astype(np.int64)
        levels = []
        for _ in range(self.height):
            parent = here >> np.uint64(2)
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(here)]))
            over = np.maximum.reduceat(top, first)
            levels.append((4 * number + (here & np.uint64(3)).astype(np.int64), (over[number] - top).astype(np.uint32), 4 * len(first)))
            here, top = parent[first], over
        self.top = int(top[0])
        levels.reverse()
        bits = np.zeros(-(-sum(n for *_, n in levels) // 64) * 64, bool)
        start = 0
        for at, _, n in levels:
            bits[start + at] = True
            start += n
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))][:-1]
        self.below = np.concatenate([d for _, d, _ in levels])

    def _step(self, node: np.ndarray, value: np.ndarray, bit: np.ndarray, half: int):
        """Child cells (-1: empty) and their maxima, in one half of the documents."""
        at = 4 * np.maximum(node, 0) + 2 * bit + half
        word, place = at >> 6, (at & 63).astype(np.uint64)
        held = self.words[word]
        child = self.before[word] + np.bitwise_count(held & ((np.uint64(2) << place) - np.uint64(1)))
        there = (node >= 0) & ((held >> place) & np.uint64(1) == 1)
        below = self.below[np.where(there, child, 1) - 1]
        return np.where(there, child, -1), np.where(there, value - below, 0)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int = BEST) -> list[tuple[int, int]]:
        """(score, column) of the k best columns: higher weighted sums of impacts first, then smaller columns."""
        width, high = len(rows), rows.astype(np.int64) << self.shift
        cells, values = np.zeros((256, width), np.int32), np.zeros((256, width), np.uint32)
        values[0] = self.top
        free = list(range(255, 0, -1))
        limit = max(4 * OPEN * self.height, FRONTIER // max(1, width))
        waiting = [(-int(weights.sum()) * self.top, 0, 0, 0)]  # less bound, first column, level, slot
        found: list[tuple[int, int]] = []  # the worst first: score, less column
        deep = False

        def late(entry) -> bool:
            return len(found) == k and (entry[0], entry[1]) > (-found[0][0], -found[0][1])

        while waiting:
            if not deep and len(waiting) > limit:
                waiting.sort(reverse=True)  # from here a stack, the best on top
                deep = True
            opened = []
            while waiting and len(opened) < OPEN:
                entry = waiting.pop() if deep else heapq.heappop(waiting)
                if not late(entry):
                    opened.append(entry)
                elif not deep:
                    waiting = []
                else:
                    free.append(entry[3])
            if not opened:
                continue
            slots = [e[3] for e in opened]
            start, level = np.array([e[1] for e in opened]), np.array([e[2] for e in opened])
            down = self.height - 1 - level
            bit = (high >> down[:, None]) & 1
            node, value = cells[slots].astype(np.int64), values[slots].astype(np.int64)
            free += slots
            if len(free) < 2 * len(opened):
                more = len(cells)
                cells, values = (np.concatenate([x, np.zeros_like(x)]) for x in (cells, values))
                free = [*range(2 * more - 1, more - 1, -1), *free]
            pushed = []
            for half in (0, 1):
                child, own = self._step(node, value, bit, half)
                bound = own @ weights
                first = start + (half << down)
                for j in np.flatnonzero(bound > 0).tolist():
                    entry = (-int(bound[j]), int(first[j]), int(level[j]) + 1, -1)
                    if late(entry):
                        continue
                    if entry[2] == self.height:
                        got = (int(bound[j]), -entry[1])
                        (heapq.heappush if len(found) < k else heapq.heappushpop)(found, got)
                        continue
                    slot = free.pop()
                    cells[slot], values[slot] = child[j], own[j]
                    pushed.append((*entry[:3], slot))
            if deep:
                waiting += sorted(pushed, reverse=True)
            else:
                for entry in pushed:
                    heapq.heappush(waiting, entry)
        return [(s, -c) for s, c in sorted(found, reverse=True)]


# ---- Spark ----------------------------------------------------------------------------------------


class Queries:
    """A block of items: their vocabulary, and for each item its terms' numbers and how often each stands there."""

    def __init__(self, items: list[tuple]):
        counted = [(number, item_id, Counter(terms(text))) for number, item_id, text in items]
        self.number = {t: n for n, t in enumerate(sorted(set().union(*(c for *_, c in counted))))}
        self.items = [
            (n, i, np.array([self.number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for n, i, c in counted if c
        ]


def _occurrences(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``at`` (numbers of the asked terms in it), ``tf`` of each document."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sizes, at, tf = [], [], []
                for text in part["text"]:
                    words = terms(text.as_py())
                    known = Counter(map(number.get, words))
                    known.pop(None, None)
                    sizes.append(len(words))
                    at.append(list(known))
                    tf.append(list(known.values()))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(sizes, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))],
                    ["doc_id", "n", "at", "tf"],
                )

    return texts(docs).mapInArrow(rows, "doc_id long, n long, at array<int>, tf array<int>")


def _searched(seen: DataFrame, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Up to ``k`` best documents of each item in each shard."""
    shard, items = SHARD, queries.items

    def answers(held: list[pa.RecordBatch]):
        got = pa.Table.from_batches(held).combine_chunks()
        known = got["doc_id"].is_valid().to_numpy()
        ids = got["doc_id"].fill_null(0).to_numpy()
        order = np.lexsort((ids, ~known))  # null last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lists = got["at"].chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        column = np.repeat(place, sizes)
        term, tf = lists.flatten().to_numpy().astype(np.int64), got["tf"].chunk(0).flatten().to_numpy().astype(np.int64)
        m = np.repeat(100 - 25 + (25 * got["n"].to_numpy() * n_docs) // n_terms, sizes)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
        # Rows by how common a term is, so that cells of several rows hold terms of a kind.
        count = np.bincount(term, minlength=len(weights))
        row = np.empty(len(weights), np.int64)
        row[np.argsort(-count, kind="stable")] = np.arange(len(weights))
        grid = Treap(row[term], column, impact)
        out: list[tuple] = []
        for number, item_id, asked, times in items:
            use = (count[asked] > 0) & (weights[asked] > 0)
            if use.any():
                for score, c in grid.best(row[asked[use]], weights[asked[use]] * times[use], k):
                    at = order[c]
                    out.append((number, item_id, int(ids[at]) if known[at] else None, score))
        cols = zip(*out) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["item", "item_id", "doc_id", "score"])

    def rows(batches: Iterator[pa.RecordBatch]):
        held, waiting = [], 0
        for batch in batches:
            held.append(batch)
            waiting += len(batch["at"].flatten())
            if waiting >= shard:
                yield answers(held)
                held, waiting = [], 0
        if waiting:
            yield answers(held)

    found = seen.filter(F.size("at") > 0).mapInArrow(rows, "item long, item_id long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of each item with a score above 0.

    Scores are sums over the item's terms, repeats included, of whole-number weights and impacts; every
    document is counted and ranked. Equal scores go by ascending doc_id, null last. Each row of either
    table is an item or a document of its own, also a repeated one. A null text has no terms; an item
    without terms, or whose terms no document holds, has no rows, as has an empty table. Other columns do not count.

    Items are taken in blocks of bounded size, which travel to the executors: one pass over the documents for each.
    """
    numbered = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = materialise(numbered.withColumn("item", F.monotonically_increasing_id()), "items")
    size = numbered.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // ITEM_CHARS))
    out = None
    for block in range(blocks):
        part = numbered.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        queries = Queries([(r["item"], r["item_id"], r["text"]) for r in part.orderBy("item").collect()])
        seen = materialise(_occurrences(docs, queries.number), "occurrences")
        total = seen.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        # As many rows as the block's vocabulary.
        df = seen.select(F.explode("at").alias("t")).groupBy("t").count().collect()
        weights = np.zeros(len(queries.number), np.int64)
        for r in df:
            weights[r["t"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["count"] + 1)))
        found = _searched(seen, queries, weights, total["docs"], total["terms"] or 1, k)
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", "rank", "doc_id", "score")
