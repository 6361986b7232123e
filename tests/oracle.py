"""Side-by-side run of a Spark query and its SQL twin in DuckDB."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strataflow-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def _type_name(t: pa.DataType) -> str:
    return {"large_string": "string", "large_list": "list"}.get(str(t), str(t))


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return repr(v)


def rows_of(table: pa.Table) -> Counter:
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return Counter(zip(*columns))


def compare(spark_table: pa.Table, duck_table: pa.Table) -> list[str]:
    """Differences between two results: names, types, counts, values."""
    problems = []
    a, b = sorted(spark_table.column_names), sorted(duck_table.column_names)
    if a != b:
        return [f"columns differ: only spark {set(a) - set(b)}, only sql {set(b) - set(a)}"]
    for n in a:
        ta, tb = _type_name(spark_table.schema.field(n).type), _type_name(duck_table.schema.field(n).type)
        if ta != tb:
            problems.append(f"type of {n}: spark {ta}, sql {tb}")
    if spark_table.num_rows != duck_table.num_rows:
        problems.append(f"rows: spark {spark_table.num_rows}, sql {duck_table.num_rows}")
    ra, rb = rows_of(spark_table), rows_of(duck_table)
    if ra != rb:
        only_a, only_b = ra - rb, rb - ra
        problems.append(
            f"values: {sum(only_a.values())} rows only in spark, e.g. {list(only_a)[:2]}; "
            f"{sum(only_b.values())} only in sql, e.g. {list(only_b)[:2]}; columns {a}"
        )
    return problems
