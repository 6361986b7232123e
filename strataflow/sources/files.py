"""Finding, reading and writing result files."""

from __future__ import annotations

import csv
import re
import sys
from functools import reduce
from typing import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import as_col, matches
from ..functions.numbers import safe_cast
from ..operators.sets import ragged_union

# Task functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Which files hold which result. A path may be of several classes.
FILE_CLASSES = {
    "snapshot": {"all": ["snapshot"]},
    "incidence_estimates": {"all": ["Incidence", ".csv"], "none": ["attrition"]},
    "incidence_attrition": {"all": ["Incidence", ".csv", "attrition"]},
    "characterisation": {"all": ["tableOne"]},
    "attrition_infection": {"all": ["attrition_infection"]},
}

# Names an unnamed row-index column may have after reading.
INDEX_COLUMNS = ("...1", "_c0", "")


def class_flags(path: Column | str, rules: Mapping[str, Mapping[str, Sequence[str]]]) -> dict[str, Column]:
    """One boolean per class: all of its patterns match and none of the excluded ones does."""
    flags = {}
    for name, rule in rules.items():
        flag = F.lit(True)
        for pattern in rule.get("all", ()):
            flag = flag & matches(path, pattern)
        for pattern in rule.get("none", ()):
            flag = flag & ~matches(path, pattern)
        flags[name] = flag
    return flags


def classify_paths(df: DataFrame, path_col: str = "path", rules=FILE_CLASSES) -> DataFrame:
    return df.withColumns(class_flags(as_col(path_col), rules))


def classify_files(spark: SparkSession, root: str, rules=FILE_CLASSES) -> DataFrame:
    """All files below a folder with their class flags. File contents are not read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(literal_path(root)).select("path")
    )
    return classify_paths(listed, "path", rules)


# A quote inside quoted text is doubled, as spreadsheet and statistics programs write it.
# Edge blanks of a text are part of it.
_CSV_FORMAT = {
    "header": True,
    "nullValue": "NA",
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def literal_path(path: str) -> str:
    """A path as a reader takes it: characters with a meaning in path patterns stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def plain_path(uri: str) -> str:
    """The path behind a file's URI, in which blanks and some other characters are encoded."""
    return unquote(uri)


def _csv_reader(spark: SparkSession, schema: T.StructType, multi_line: bool = False):
    """Typed reader that fails on a value or header that does not fit, instead of losing it."""
    return (
        spark.read.schema(schema)
        .options(**_CSV_FORMAT, multiLine=multi_line)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
    )


def _blank_to_null(df: DataFrame) -> DataFrame:
    """Empty text counts as missing, like ``NA``."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(as_col(c), F.lit("")) for c in texts}) if texts else df


# Files up to this size are read whole to find their header, many in a task.
SMALL_FILE = 1 << 20
# Larger files looked into by one job.
_AT_ONCE = 100


def _uncut(spark: SparkSession) -> SparkSession:
    """A session like this one whose scans do not cut files."""
    side = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if value is not None and side.conf.isModifiable(name):
            side.conf.set(name, value)
    side.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 50))
    return side


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The lines of files as bytes, with their file's path."""
    return spark.read.text([literal_path(p) for p in paths]).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, texts = batch["path"].to_pylist(), []
        for path, line in zip(paths, batch["line"].to_pylist()):
            try:
                texts.append(line.decode("utf-8").removeprefix("\ufeff"))
            except UnicodeDecodeError as e:
                raise ValueError(f"the header of {unquote(path)} is not UTF-8 text: {e}") from None
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "header"])


def _heads(spark: SparkSession, paths: Sequence[str]) -> Iterator[DataFrame]:
    """``path``, ``line`` (the first one) of the files, small and large ones apart; empty files have none."""
    listed = spark.read.format("binaryFile").load([literal_path(p) for p in paths]).select("path", "length")
    sizes = {r["path"]: r["length"] for r in listed.filter(as_col("length") > 0).collect()}
    large = [p for p, n in sizes.items() if n > SMALL_FILE]
    small = [p for p, n in sizes.items() if n <= SMALL_FILE]
    side = _uncut(spark) if large else spark
    for at in range(0, len(large), _AT_ONCE):
        # A task for each file: one partition, so the limit needs no exchange, and it ends the scan.
        each = [_lines(side, [p]).select("path", "line").coalesce(1).limit(1) for p in large[at : at + _AT_ONCE]]
        yield reduce(DataFrame.unionByName, each)
    if small:
        # The part of a file that starts at byte 0 is read in order by one task: its row of smallest id is the first.
        numbered = _lines(spark, small).withColumn("id", F.monotonically_increasing_id())
        yield numbered.filter(as_col("start") == 0).groupBy("path").agg(F.min_by("line", "id").alias("line"))


def header_signatures(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Files grouped by header line; empty files are left out.

    Spark opens the files, wherever they lie: small ones whole, many in a task; each larger one in a task of
    its own under a limit of one line, so that only a buffer of the file is read. The driver
    receives one row per distinct header. A file that is missing or may not be read, and a header
    that is not UTF-8 text, fail.
    """
    groups: dict[str, list[str]] = {}
    for heads in _heads(spark, paths):
        named = heads.mapInArrow(_decoded, "path string, header string")
        for row in named.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect():
            if row["header"]:
                groups.setdefault(row["header"], []).extend(plain_path(p) for p in row["paths"])
    return groups


def _only_utf8(df: DataFrame) -> DataFrame:
    """Fails, naming the file, where bytes that are no UTF-8 text were read as replacement characters."""
    problem = F.raise_error(F.concat(F.lit("not UTF-8 text in "), F.col("_metadata.file_path")))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    checked = {c: F.when(F.contains(as_col(c), F.lit("\ufffd")), problem).otherwise(as_col(c)) for c in texts}
    return df.withColumns(checked) if checked else df


def _header_names(header: str) -> list[str]:
    """Column names of a header line; an unnamed column gets the name Spark gives it."""
    return [h if h else f"_c{i}" for i, h in enumerate(next(csv.reader([header])))]


def read_results(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType,
    ragged: bool = True,
    path_col: str | None = None,
    extras: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Union of headered CSV files by column name, with the declared types.

    Spark matches CSV columns by position, so files are read once per distinct header and united by
    name; a column a file lacks is NULL and an unnamed index column is dropped. Undeclared columns
    are dropped too, or with ``extras`` passed through as text. Empty files give no rows. ``ragged=False`` skips the header
    pass for files known to share the declared header, and fails if one does not.
    """

    def finish(df: DataFrame) -> DataFrame:
        tagged = df
        if path_col:
            path = F.try_url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
            tagged = df.withColumn(path_col, path)
        kept = [c for c in tagged.columns if c not in INDEX_COLUMNS]
        return _blank_to_null(_only_utf8(tagged).select(*[as_col(c) for c in kept]))

    if not ragged:
        return finish(_csv_reader(spark, schema, multi_line).csv([literal_path(p) for p in paths]))
    types = {f.name: f.dataType for f in schema.fields}
    parts = []
    for header, files in sorted(header_signatures(spark, paths).items()):
        declared = T.StructType(
            [T.StructField(n, types.get(n, T.StringType())) for n in _header_names(header)]
        )
        files = [literal_path(p) for p in files]
        parts.append(finish(_csv_reader(spark, declared, multi_line).csv(files)))
    if not parts:
        columns = [*schema.fields, *([T.StructField(path_col, T.StringType())] if path_col else [])]
        return spark.createDataFrame([], T.StructType(columns))
    out = ragged_union(parts)
    absent = {n: F.lit(None).cast(types[n]) for n in schema.fieldNames() if n not in out.columns}
    out = out.withColumns(absent) if absent else out
    wanted = [*schema.fieldNames(), *([path_col] if path_col else [])]
    if extras:
        wanted += [c for c in out.columns if c not in wanted]
    return out.select(*[as_col(c) for c in wanted])


def write_export(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Write a displayed table as headered CSV, one folder per key value.

    The rebalance hint brings rows of one key together but lets adaptive execution split a key
    that holds too much for one task, so no file and no task grows with a hot key.
    """
    if keys:
        df = df.hint("rebalance", *[as_col(k) for k in keys])
    writer = df.write.options(**_CSV_FORMAT)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.csv(path)


def read_export(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Read back an export, key folders included; ``multi_line`` for text that holds line breaks.

    A file with line breaks in its values cannot be read in several parts; write such exports in more files.
    """
    df = _csv_reader(spark, schema, multi_line).csv(path)
    return _blank_to_null(df).select(*[as_col(c) for c in schema.fieldNames()])


def normalised_name(header: str) -> str:
    """Header text as an identifier: every other character becomes a dot."""
    return "".join(ch if ch.isalnum() or ch in "._" else "." for ch in header)


def covariate_series(
    spark: SparkSession,
    path: str,
    mapping: Mapping[str, str],
    date_col: str | None = None,
    number_cols: Sequence[str] = (),
) -> DataFrame:
    """One external CSV with awkward headers: pick ``{header: name}`` columns and type them.

    Headers may be given as they stand in the file or normalised. ``date_col`` and ``number_cols``
    are new names; the other columns stay text. Files of a folder are matched by header, each for itself;
    a date or number that is none fails the read.
    """
    parts = []
    for header, files in sorted(header_signatures(spark, _files_below(spark, path)).items()):
        names = _header_names(header)
        by_name = {**{normalised_name(c): c for c in names}, **{c: c for c in names}}
        absent = [h for h in mapping if h not in by_name]
        if absent:
            raise ValueError(f"headers not found: {', '.join(absent)}")
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = _only_utf8(_csv_reader(spark, text).csv([literal_path(p) for p in files]))
        parts.append(raw.select(*[as_col(by_name[h]).alias(n) for h, n in mapping.items()]))
    if not parts:
        raise ValueError(f"headers not found: no file with a header at {path}")
    out = _blank_to_null(ragged_union(parts))
    typed = {n: _fitting(n, "double") for n in number_cols}
    if date_col is not None:
        typed[date_col] = _fitting(date_col, "date")
    return out.withColumns(typed) if typed else out


def _fitting(c: str, data_type: str) -> Column:
    """Cast that fails, naming the value, where a text is not of the type."""
    cast = safe_cast(c, data_type)
    problem = F.raise_error(F.concat(F.lit(f"{c} is not a {data_type}: "), as_col(c)))
    return F.when(as_col(c).isNotNull() & cast.isNull(), problem).otherwise(cast)


def _files_below(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, a folder's hidden ones left out. Contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(literal_path(path))
    return [r["path"] for r in listed.select("path").collect()]
