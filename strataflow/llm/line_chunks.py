"""Line dedup by content-defined chunks: rolling hashes over line hashes choose the boundaries."""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import apart, bit_filter, map_rows, passes, text_key, texts

LONG_LINE = 50  # words; such a line is a chunk of its own
MEAN_LINES = 2
MULTIPLIER, MODULUS = 31, 1_000_003


def line_hash(line: str) -> int:
    """The first 60 bits of the MD5."""
    return int(hashlib.md5(line.encode()).hexdigest()[:15], 16)


def chunks(text: str) -> Iterator[tuple[int, int, str]]:
    """(first line, lines, text) of each removable chunk: several lines, or one long line.

    A chunk ends after a line where the rolling hash of the line and the one before is divisible by
    ``MEAN_LINES``, and on both sides of a long line. Boundaries depend on the lines around them only,
    so text put in elsewhere does not move them.
    """
    lines = text.split("\n")
    wide = [line.count(" ") + 1 >= LONG_LINE for line in lines]
    hashes = [line_hash(line) % MODULUS for line in lines]
    first = 0
    for i in range(len(lines)):
        rolled = (hashes[i] + MULTIPLIER * (hashes[i - 1] if i else 0)) % MODULUS
        last = i + 1 == len(lines)
        if last or wide[i] or wide[i + 1] or rolled % MEAN_LINES == 0:
            n = i + 1 - first
            if n > 1 or wide[i]:
                yield first, n, "\n".join(lines[first : i + 1])
            first = i + 1


def windows(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of the shortest runs of lines with ``LONG_LINE`` words or more.

    For each line there is the shortest run that starts with it and the shortest that ends with it, each
    once. Wherever a passage of so many words stands, its lines are covered by such runs within it: a
    line with enough words after it by the run that starts there, one with enough before it by the run that
    ends there, any other by the last run of the passage that starts before it.
    """
    raw = text.encode()
    lines = raw.split(b"\n")
    ends = np.cumsum([len(line.split()) for line in lines])
    starts = np.cumsum([0, *(len(line) + 1 for line in lines)]).tolist()
    before = np.concatenate([[0], ends[:-1]])
    last = np.searchsorted(ends, before + LONG_LINE)
    first = np.searchsorted(before, ends - LONG_LINE, side="right") - 1
    runs = {(a, b) for a, b in enumerate(last.tolist()) if b < len(lines)}
    runs |= {(a, b) for b, a in enumerate(first.tolist()) if a >= 0}
    for a, b in sorted(runs):
        yield a, b + 1 - a, raw[starts[a] : starts[b + 1] - 1]


def _pieces(text: str, whole: bool) -> Iterator[tuple[int, int, bytes, bool]]:
    """(first line, lines, bytes, whether a window) of the chunks and, if ``whole``, of the windows."""
    for first, n, chunk in chunks(text):
        yield first, n, chunk.encode(), False
    if whole:
        for first, n, piece in windows(text):
            yield first, n, piece, True


def _signed_hash(piece: bytes, window: bool) -> int:
    return xxhash.xxh64_intdigest(piece, int(window)) - (1 << 63)


def repeated_chunks(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``doc_id``, ``rk``, ``first_line``, ``n_lines`` of every chunk to remove.

    With ``whole``, of every window to remove too: so each repeated passage of ``LONG_LINE`` words or more
    goes wholly, wherever chunks end. A window that overlaps the first place itself stays. Windows
    overlap, so they are compared by their SHA-256 instead of their bytes.

    Of chunks with equal bytes anywhere in the table the first place stays: smallest doc_id (null
    first), then text hash, then line. Rows equal in doc_id and text are one document.

    A first pass shuffles hashes only. A second one reads the texts again and shuffles the text of those
    chunks whose hash occurs more than once, for the comparison of bytes.
    """
    read = texts(docs).withColumn("rk", text_key())
    place = F.struct("doc_id", "rk", "first_line")

    def hashed(batches: Iterator[dict]):
        for b in batches:
            for i, k, t in zip(b["doc_id"], b["rk"], b["text"]):
                for first, _, piece, window in _pieces(t, whole):
                    yield i, k, first, _signed_hash(piece, window)

    seen = map_rows(read, hashed, "doc_id long, rk long, first_line int, h long")
    twice = seen.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    twice = materialise(twice.filter(~F.col("a").eqNullSafe(F.col("b"))).select("h"), "repeated")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(twice))

    def suspected(batches: Iterator[dict]):
        for b in batches:
            found = [
                (i, k, first, n, _signed_hash(piece, window), piece, window)
                for i, k, t in zip(b["doc_id"], b["rk"], b["text"])
                for first, n, piece, window in _pieces(t, whole)
            ]
            if found:
                hits = passes(bits.value, np.array([f[4] for f in found], np.int64))
                for (*f, piece, window), hit in zip(found, hits):
                    if hit:
                        yield *f, hashlib.sha256(piece).hexdigest() if window else piece.decode(), window

    places = map_rows(read, suspected, "doc_id long, rk long, first_line int, n_lines int, h long, chunk string, window boolean")
    places = places.join(twice, "h", "left_semi")
    owners = places.groupBy("h", "chunk", "window").agg(F.min(place).alias("owner"), F.max(place).alias("last"))
    owners = owners.filter(~F.col("owner").eqNullSafe(F.col("last"))).drop("last")
    # Both sides grow with the input: a merge at every size, in which a hot chunk can be split.
    copies = places.join(owners.hint("merge"), ["h", "chunk", "window"]).filter(~place.eqNullSafe(F.col("owner")))
    if whole:
        same = F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("rk") == F.col("owner.rk"))
        over = F.col("first_line") < F.col("owner.first_line") + F.col("n_lines")
        copies = copies.filter(~(F.col("window") & same & over))
    return copies.select("doc_id", "rk", "first_line", "n_lines").distinct()


def _without(text, ranges):
    @F.arrow_udf("string")
    def cleaned(text: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array([_drop(t.as_py(), r.as_py()) for t, r in zip(text, ranges)], pa.string())

    return cleaned(text, ranges)


def _drop(text, ranges):
    if text is None or ranges is None:
        return None
    gone = {i for r in ranges for i in range(r["first_line"], r["first_line"] + r["n_lines"])}
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)


def remove_repeated(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` with repeated chunks, and repeated windows if ``whole``, taken out of ``text``, and ``removed_lines``; other columns as they are.

    A column named ``removed_lines`` is replaced. Lines end at line feeds. A null text stays null, a text all of whose lines go becomes empty, and no row goes.
    """
    gone = repeated_chunks(docs, whole)
    ranges = gone.groupBy("doc_id", "rk").agg(
        F.collect_list(F.struct("first_line", "n_lines")).alias("__ranges"), F.sum("n_lines").alias("__lines")
    )
    if whole:
        each = F.transform("__ranges", lambda r: F.sequence(r.first_line, r.first_line + r.n_lines - 1))
        ranges = ranges.withColumn("__lines", F.size(F.array_distinct(F.flatten(each))).cast("long"))
    ranges = materialise(ranges.select(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk"), "__ranges", "__lines"), "ranges")
    marked = docs.withColumn("__key", text_key())
    place = F.xxhash64(F.col("doc_id").cast("long"), "__key")
    # Only texts that may lose lines are shuffled.
    concerned, rest = apart(marked, place, ranges.select(F.xxhash64("__id", "__rk").alias("h")))
    same = concerned["doc_id"].cast("long").eqNullSafe(ranges["__id"]) & (concerned["__key"] == ranges["__rk"])
    joined = concerned.join(ranges.hint("merge"), same, "left")
    hit = F.when(F.col("__ranges").isNotNull(), F.col("text"))
    cleaned = joined.withColumn("__clean", _without(hit, F.col("__ranges")))
    kept = F.when(F.col("__ranges").isNotNull(), F.col("__clean")).otherwise(F.col("text")).alias("text")
    others = [c for c in docs.columns if c.lower() != "removed_lines"]
    columns = [kept if c.lower() == "text" else F.col(f"`{c}`") for c in others]
    cleaned = cleaned.select(*columns, F.coalesce("__lines", F.lit(0)).cast("long").alias("removed_lines"))
    unchanged = rest.select(*[F.col(f"`{c}`") for c in others], F.lit(0).cast("long").alias("removed_lines"))
    return cleaned.unionByName(unchanged)


def with_lengths(docs: DataFrame) -> DataFrame:
    """``n_chars``, where the table has it, brought in line with texts that lost lines."""
    if "n_chars" not in docs.columns:
        return docs
    changed = F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return docs.withColumn("n_chars", changed.cast("long"))
