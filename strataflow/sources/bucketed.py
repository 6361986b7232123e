"""Tables stored by the hash of their keys, so that windows and groups over the keys move nothing.

A bucket is read by one task. So this is for tables whose rows per key are bounded, such as rolled-up
series (at most one row per period); raw rows with a hot key belong in the silver layer.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.missing import as_col


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fresh() -> str:
    return f"bucketed_{uuid.uuid4().hex}"


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 200) -> None:
    """Write ``{path}/rows`` in ``buckets`` files by the hash of ``keys``, each sorted by keys and ``order``.

    How it is laid out is written beside it, last: a table whose writing was cut short cannot be read. A path
    that holds a table already fails.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    name = _fresh()
    keys, order = list(keys), list(order)
    # The same hash as the buckets', so every bucket is one file.
    dealt = df.repartition(buckets, *[as_col(k) for k in keys])
    layout = spark.createDataFrame([(keys, order, buckets)], "keys array<string>, order array<string>, buckets int")
    try:
        writer = dealt.write.mode("errorifexists").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *order)
        writer.option("path", f"{path}/rows").saveAsTable(name)
    finally:
        # The table's name goes, its files stay.
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    layout.coalesce(1).write.mode("errorifexists").json(f"{path}/layout")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of :func:`write_bucketed`, in any session: Spark knows its buckets and does not shuffle by its keys."""
    path = path.rstrip("/")
    layout = spark.read.schema("keys array<string>, order array<string>, buckets int").json(f"{path}/layout").first()
    columns = ", ".join(
        f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/rows").schema.fields
    )
    keys = ", ".join(map(_quoted, layout["keys"]))
    sorted_by = ", ".join(map(_quoted, [*layout["keys"], *layout["order"]]))
    name = _fresh()
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({keys}) SORTED BY ({sorted_by}) INTO {layout['buckets']} BUCKETS LOCATION {_text(path + '/rows')}"
    )
    return spark.table(name)
