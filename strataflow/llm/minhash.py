"""MinHash fingerprints: universal hash permutations over shingles, bands, verified similarity."""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import map_rows, texts, text_key

PERMUTATIONS = 128
BAND_ROWS = 6
CACHE = 100_000
_RNG = np.random.Generator(np.random.PCG64(7))
_A = (_RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


class Shingler:
    """Hashes of a text's word shingles, from remembered word hashes."""

    def __init__(self, words: int = 5):
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        """Distinct 64-bit shingle hashes of the ASCII lower-cased text; fewer words: one of them all; none: no hash."""
        w = text.encode().lower().split()
        if not w:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        known.update((x, xxhash.xxh64_intdigest(x, 1)) for x in set(w).difference(known))
        h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        size = min(self.words, len(h))
        rolled = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
            rolled ^= rolled >> np.uint64(29)
        return np.unique(rolled)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Per permutation h -> a * h + b (mod 2^32, a odd) the smallest value; no hash: the largest number."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        block = np.multiply.outer(_A, low[at : at + 512])
        block += _B[:, None]
        np.minimum(best, block.min(axis=1), out=best)
    return best


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal signature values: an estimate of the Jaccard similarity of the shingle sets."""
    return float(np.count_nonzero(a == b)) / PERMUTATIONS


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id``, ``rk`` (tells apart texts that share a number), ``fingerprint`` of every row."""

    def rows(batches: Iterator[dict]):
        shingles = Shingler(words)
        for b in batches:
            for i, k, t in zip(b["doc_id"], b["rk"], b["text"]):
                yield i, k, as_text(signature(shingles(t)))

    keyed = texts(docs).withColumn("rk", text_key())
    return map_rows(keyed, rows, "doc_id long, rk long, fingerprint string", 500)


def banded(prints: DataFrame) -> DataFrame:
    """One row per band: band number and values."""
    wide = BAND_ROWS * 8
    bands = [
        F.struct(F.lit(i).alias("band"), F.substring("fingerprint", i * wide + 1, wide).alias("values"))
        for i in range(PERMUTATIONS // BAND_ROWS)
    ]
    return prints.select("*", F.explode(F.array(*bands)).alias("e")).select(*prints.columns, "e.band", "e.values")


def similar_pairs(left: DataFrame, right: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``left_id``, ``right_id``, ``similarity`` of all pairs of distinct texts that share a band, verified exactly.

    Each side has ``doc_id``, ``text``. Equal texts of a side are one, named by their smallest doc_id,
    so copies are never expanded. A query set against a table; empty sides give no pairs.
    """

    def distinct(side):
        return texts(side).groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")

    a, b = (materialise(distinct(s).withColumn("rk", text_key()), "texts") for s in (left, right))
    pa_, pb = (banded(fingerprints(s, words)) for s in (a, b))
    x = pa_.select(F.col("doc_id").alias("left_id"), F.col("rk").alias("lk"), "band", "values")
    y = pb.select(F.col("doc_id").alias("right_id"), F.col("rk").alias("rk"), "band", "values")
    met = x.join(y, ["band", "values"]).select("left_id", "lk", "right_id", "rk").distinct()
    with_left = met.join(a.select(F.col("doc_id").alias("left_id"), F.col("rk").alias("lk"), F.col("text").alias("lt")), ["left_id", "lk"])
    both = with_left.join(b.select(F.col("doc_id").alias("right_id"), "rk", F.col("text").alias("rt")), ["right_id", "rk"])

    def rows(batches):
        shingles = Shingler(words)
        for c in batches:
            for i, j, s, t in zip(c["left_id"], c["right_id"], c["lt"], c["rt"]):
                p, q = shingles(s), shingles(t)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                both_sizes = len(p) + len(q) - shared
                alike = shared / both_sizes if both_sizes else 1.0
                if alike >= similarity:
                    yield i, j, alike

    return map_rows(both.select("left_id", "right_id", "lt", "rt"), rows, "left_id long, right_id long, similarity double")


def fingerprint_neighbours(docs: DataFrame, pieces: int | None = None, words: int = 5) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness to each other and to the next.

    The next document is the one after it by descending doc_id (null last, rows of one number by
    descending text hash, then text); the first follows the last. The edited text has its last
    floor(n_chars / 3) code points replaced by the first as many of the next text, or all of it.
    A null text counts as empty. A single row follows itself. An empty table gives an empty table.

    ``near_*`` is the share of equal values of the two fingerprints.

    The texts are shuffled once, into ranges of doc_id whose bounds come from quantiles; what a range
    needs from the next one is its first row, found by a filter on the list of first numbers (three for
    each shuffle partition). A range streams through its task, two texts at a time.
    """
    rows = texts(docs)
    spark = docs.sparkSession
    n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / (3 * n) for i in range(1, 3 * n)]
    cuts = rows.agg(F.percentile_approx("doc_id", steps, 10_000)).first()[0] or []
    # Piece 0 holds the largest numbers; null numbers come last.
    number = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    bounds = F.lit(sorted(set(cuts))) if cuts else F.lit([0])
    placed = rows.withColumn("rk", text_key()).withColumn("piece", F.size(F.filter(bounds, lambda c: number < c)))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "rk")
    heads = placed.groupBy("piece").agg(F.max(order).alias("head")).orderBy("piece").collect()
    heads = [(h["head"]["doc_id"], h["head"]["rk"], heads[k - 1]["piece"]) for k, h in enumerate(heads)]
    wanted = F.col("doc_id").isin([i for i, _, _ in heads if i is not None])
    if any(i is None for i, _, _ in heads):
        wanted = wanted | F.col("doc_id").isNull()
    ends = spark.createDataFrame(heads, "doc_id long, rk long, before int").alias("e")
    first = placed.filter(wanted).filter(F.col("rk").isin([k for _, k, _ in heads])).alias("p")
    first = first.join(ends, F.col("p.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("p.rk") == F.col("e.rk")))
    # Equal rows are equal heads: one of them will do.
    first = first.groupBy("e.before").agg(F.max(F.struct("p.doc_id", "p.rk", "p.text")).alias("h"))
    first = first.select("h.doc_id", "h.text", "h.rk", F.col("before").alias("piece"), F.lit(True).alias("end"))
    dealt = (
        placed.withColumn("end", F.lit(False))
        .unionByName(first)
        .repartition(n, "piece")
        .sortWithinPartitions("piece", "end", F.desc_nulls_last("doc_id"), F.desc("rk"), F.desc("text"))
    )

    def finished(batches):
        shingles = Shingler(words)
        held = None
        for b in batches:
            for i, end, text in zip(b["doc_id"], b["end"], b["text"]):
                now = (i, text, signature(shingles(text)))
                if held is not None:
                    yield _row(held, now, shingles)
                held = None if end else now

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return map_rows(dealt.select("doc_id", "end", "text"), finished, schema, 500)


def _row(this, following, shingles) -> tuple:
    doc_id, text, sig = this
    cut = len(text) // 3
    edited = text[: len(text) - cut] + following[1][:cut]
    changed = signature(shingles(edited))
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return doc_id, len(text), digest, as_text(sig), as_text(changed), likeness(sig, changed), likeness(sig, following[2])
