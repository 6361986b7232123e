"""Shared pieces: input columns, Arrow loops, bit filters, shingles."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_BITS = (20, 26)
# An Arrow batch ends after the row with which its texts reach so many code points.
BATCH_CHARS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold few rows, as rows are whole texts: a session setting, lowered if it is higher."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text is an empty one. Other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_key(text: str | Column = "text") -> Column:
    """Tells apart rows that share a document number; rows equal in both are one document."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[tuple]], schema: str, block: int = 2000) -> DataFrame:
    """Run ``rows`` over the column lists of each Arrow batch; it yields tuples of the schema's columns."""
    arrow = pa.schema(_arrow_schema(df.sparkSession, schema))

    def run(batches):
        yield from batched(rows(batch.to_pydict() for batch in small(batches)), arrow, block)
        pa.default_memory_pool().release_unused()  # the worker process lives on

    def small(batches):
        # Python objects of a few hundred rows at a time, however long the texts are.
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield batch.slice(at, 256)

    return df.mapInArrow(run, schema)


def batched(rows: Iterator[tuple], schema: pa.Schema, block: int, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``block`` rows, fewer where texts are long: a batch ends when they reach ``chars`` code points."""
    long = [k for k, t in enumerate(schema.types) if pa.types.is_string(t) or pa.types.is_binary(t)]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    out, held = [], 0
    for row in rows:
        out.append(row)
        for k in long:
            held += len(row[k] or "")
        if len(out) >= block or held >= chars:
            yield batch(out)
            out, held = [], 0
    if out:
        yield batch(out)


def _arrow_schema(spark, schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def bit_filter(hashes: DataFrame, column: str = "h") -> np.ndarray:
    """Two bits per hash in a bit table, built by an aggregation; the driver receives at most 8 MB.

    The table has 16 bits per hash, between 2^20 and 2^26. A fuller table lets more rows through; a
    join on the whole hash always follows, so the size never changes a result.
    """
    low, high = FILTER_BITS
    n = hashes.count()
    bits = min(high, max(low, (16 * max(n, 1)).bit_length()))
    h = F.col(column)
    words = (
        hashes.select(F.explode(F.array(*[_place(h, s, bits) for s in (0, 1)])).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def may_be_in(table, h: Column) -> Column:
    """Whether a row's hash passes a broadcast bit table."""

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(passes(table.value, hashes.to_numpy(zero_copy_only=False)))

    return test(h)


def apart(df: DataFrame, h: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose hash is among ``hashes`` (column ``h``), with a few more, and the rest.

    Few rows of a table are often concerned by a join; so only those are shuffled for it. Reads ``df`` twice.
    """
    bits = df.sparkSession.sparkContext.broadcast(bit_filter(hashes))
    hit = may_be_in(bits, h)
    return df.filter(hit), df.filter(~hit)


def _place(h: Column, which: int, bits: int) -> Column:
    return F.shiftrightunsigned(h, 5 + 27 * which).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the table."""
    h = hashes.astype(np.int64).view(np.uint64)
    mask = np.uint64(64 * len(table) - 1)
    ok = np.ones(len(h), bool)
    for which in (0, 1):
        at = (h >> np.uint64(5 + 27 * which)) & mask
        ok &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok
