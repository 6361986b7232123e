"""Tables that change as a whole: files are written aside, then one small file names those that count.

Below a root, ``data/<table>/__load=<id>/`` holds what one load wrote, and ``commits/<version>-<id>/``
one JSON file that names the loads every table of that version consists of. That file appears whole
or not at all, so a reader sees the version before or the version after. What a load that died has
written is named by no version and never read. One writer at a time: if two commit the same version,
both and every later reader are told so.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.missing import as_col
from ..operators.sets import ragged_union
from .files import literal_path, plain_path

_LIST = "name string, load string, schema string"
_FOLDER = re.compile(r"/commits/(\d{12})-([0-9a-f]{32})/[^/]+$")


def write_laid_out(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Write a table as Parquet in folders by columns.

    Rebalancing by the layout columns gives few, even files; adaptive execution splits a value
    that outgrows one task.
    """
    out = df.hint("rebalance", *[as_col(c) for c in by]) if by else df
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def _commits(spark: SparkSession, root: str) -> dict[int, str]:
    """The folder of every version's list. Only names are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        paths = [plain_path(r["path"]) for r in listed.load(literal_path(f"{root}/commits")).select("path").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    found: dict[int, str] = {}
    for version, load in (m.groups() for m in map(_FOLDER.search, paths) if m):
        folder = f"{root}/commits/{version}-{load}"
        if found.setdefault(int(version), folder) != folder:
            raise ValueError(f"version {int(version)} was committed twice: {found[int(version)]}, {folder}")
    return found


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions of a root, oldest first; none for a root without commits."""
    return sorted(_commits(spark, root.rstrip("/")))


def _parts(spark: SparkSession, root: str, version: int | None) -> tuple[int, list[tuple[str, str, str]]]:
    """The version read (0: none yet), and (table, load, schema) of its parts: one row per table and load."""
    commits = _commits(spark, root)
    if version is None:
        version = max(commits, default=0)
    elif version not in commits:
        raise ValueError(f"no version {version} at {root}")
    if not commits:
        return 0, []
    rows = spark.read.schema(_LIST).option("mode", "FAILFAST").json(literal_path(commits[version])).collect()
    return version, [tuple(r) for r in rows]


def published(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the newest if none is given, by name; no tables where nothing was published.

    Columns that only some loads have are NULL in the others. A frame goes on reading its
    version whatever is published later.
    """
    root = root.rstrip("/")
    loads: dict[str, dict[str, list[str]]] = {}
    for name, load, schema in _parts(spark, root, version)[1]:
        loads.setdefault(name, {}).setdefault(schema, []).append(load)

    def read(name: str, schema: str, ids: list[str]) -> DataFrame:
        declared = T.StructType.fromJson(json.loads(schema))
        base = f"{root}/data/{name}"
        paths = [literal_path(f"{base}/__load={i}") for i in ids]
        df = spark.read.schema(declared).option("basePath", base).parquet(*paths)
        return df.select(*[as_col(c) for c in declared.fieldNames()])

    return {name: ragged_union([read(name, s, ids) for s, ids in parts.items()]) for name, parts in loads.items()}


def publish(
    spark: SparkSession,
    root: str,
    tables: Mapping[str, DataFrame],
    append: Iterable[str] = (),
    layout: Mapping[str, Sequence[str]] | None = None,
    whole: bool = False,
) -> int:
    """Commit a version with these tables and return its number.

    A table replaces the one of its name, or adds to it if it is among ``append``. Tables that are not
    given stay, unless ``whole`` says that these are all. ``layout`` names the columns a table's
    folders are made by. If a write fails nothing is committed. To join a table of many loads into
    one, publish what :func:`published` reads.
    """
    root, append, layout = root.rstrip("/"), set(append), layout or {}
    if not tables:
        raise ValueError("no tables to publish")
    named = [n for n, df in tables.items() if "__load" in df.columns]
    if named:
        raise ValueError(f"tables with a column __load: {', '.join(named)}")
    before, parts = _parts(spark, root, None)
    load = uuid.uuid4().hex
    for name, df in tables.items():
        write_laid_out(df, f"{root}/data/{name}/__load={load}", layout.get(name, ()))
    kept = [p for p in parts if p[0] in append or not (whole or p[0] in tables)]
    rows = kept + [(name, load, df.schema.json()) for name, df in tables.items()]
    version = before + 1
    # One partition, one file: its appearance is the commit.
    listed = spark.createDataFrame(rows, _LIST).coalesce(1)
    listed.write.mode("errorifexists").json(f"{root}/commits/{version:012d}-{load}")
    _commits(spark, root)  # fails if another writer has committed the same version
    return version
