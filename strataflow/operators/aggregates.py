"""Aggregations and pivots. Every one is a single hash aggregation with map-side combine."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, numbers
from ..functions.exact import exact_sum, quoted
from ..functions.missing import as_col, matches, plain_text, strict_avg, strict_sum
from .filters import POST_EVENT_PATTERN


def _cols(names: Sequence[str]) -> list[Column]:
    return [as_col(n) for n in names]


def _sum_of(df: DataFrame, c: str) -> Column:
    """Sum that does not depend on partitioning: of doubles by whole numbers, of other types it never does."""
    floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return exact_sum(quoted(c)) if floating else F.sum(as_col(c))


def distinct_cohorts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct attribute combinations."""
    return df.select(*_cols(cols)).distinct()


def facet_domains(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values of several columns as (column, value) text, in one pass over the input."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), plain_text(c).alias("value"))
            for c in cols
        ]
    )
    return df.select(F.inline(pairs)).distinct()


def monthly_sum_country(
    df: DataFrame,
    keys: Sequence[str] = ("month", "year", "country"),
    value: str = "cases",
) -> DataFrame:
    """Cases per month and country; NULL if any input is."""
    return df.groupBy(*_cols(keys)).agg(strict_sum(value, _sum_of(df, value)).alias(value))


def monthly_mean_index(
    df: DataFrame, keys: Sequence[str] = ("country",), date_col: str = "date", value: str = "si"
) -> DataFrame:
    """Mean of a daily index per month, dated the first of the month; NULL if any day is."""
    month = dates.month_start(date_col).alias(date_col)
    return df.groupBy(*_cols(keys), month).agg(strict_avg(value, exact_sum(quoted(value))).alias(value))


def _event_sum(na_event_fill: float) -> Column:
    filled = f"coalesce(cast(n_events as double), {float(na_event_fill)}D)"
    return exact_sum(filled).alias("n_events_sum")


def quarterly_rollup(
    df: DataFrame,
    keys: Sequence[str],
    na_event_fill: float = 1.0,
    date_col: str = "incidence_start_date",
) -> DataFrame:
    """Events and person-years per quarter.

    Suppressed (NULL) event counts count as ``na_event_fill``; a quarter with a NULL person-years
    month has NULL person-years. Output has at most one row per key and calendar quarter.
    """
    rolled = df.groupBy(
        *_cols(keys),
        F.year(as_col(date_col)).alias("year"),
        F.quarter(as_col(date_col)).alias("quarter"),
    ).agg(_event_sum(na_event_fill), strict_sum("person_years", _sum_of(df, "person_years")).alias("person_years_sum"))
    return rolled.withColumn(date_col, dates.quarter_start("year", "quarter"))


def monthly_rollup(
    df: DataFrame,
    keys: Sequence[str],
    na_event_fill: float = 1.0,
    date_col: str = "incidence_start_date",
) -> DataFrame:
    """As :func:`quarterly_rollup`, per month, with the quarter kept."""
    rolled = df.groupBy(
        *_cols(keys),
        F.year(as_col(date_col)).alias("year"),
        F.quarter(as_col(date_col)).alias("quarter"),
        F.month(as_col(date_col)).alias("month"),
    ).agg(_event_sum(na_event_fill), strict_sum("person_years", _sum_of(df, "person_years")).alias("person_years_sum"))
    return rolled.withColumn(date_col, F.make_date(as_col("year"), as_col("month"), F.lit(1)))


def max_and_argmax(df: DataFrame, value: str, arg: str, keys: Sequence[str]) -> DataFrame:
    """Largest value of a group and the first ``arg`` (in ``arg`` order) that attains it."""
    # Struct order: highest value wins, and among equals the smallest arg.
    best = F.min(
        F.when(
            as_col(value).isNotNull(),
            F.struct((-as_col(value)).alias("neg"), as_col(arg).alias("arg")),
        )
    )
    return (
        df.groupBy(*_cols(keys))
        .agg(F.max(as_col(value)).alias(f"max_{value}"), best.alias("__best"))
        .select(*_cols(keys), f"max_{value}", F.col("__best.arg").alias(f"{arg}_at_max"))
    )


def series_counts(df: DataFrame, keys: Sequence[str], distinct_col: str) -> DataFrame:
    """Rows and exact distinct values per group."""
    return df.groupBy(*_cols(keys)).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(as_col(distinct_col)).alias("n_distinct")
    )


def series_status(
    df: DataFrame,
    keys: Sequence[str],
    outcome_col: str = "outcome_cohort_name",
    date_col: str = "incidence_start_date",
    y: str = "n_events_sum",
    pt: str = "person_years_sum",
    pattern: str = POST_EVENT_PATTERN,
) -> DataFrame:
    """Whether each rolled-up series can be analysed: ``ok``, ``post_event_outcome``, ``no_records``.

    A series has no records when nothing is left of it from its first non-zero count on.
    """
    first_nonzero = F.min(F.when(as_col(y) != 0, as_col(date_col)))
    last_observed = F.max(F.when(as_col(pt).isNotNull(), as_col(date_col)))
    usable = F.coalesce(as_col("__last_observed") >= as_col("__first_nonzero"), F.lit(False))
    status = (
        F.when(matches(outcome_col, pattern), F.lit("post_event_outcome"))
        .when(~usable, F.lit("no_records"))
        .otherwise(F.lit("ok"))
    )
    return (
        df.groupBy(*_cols(keys))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            first_nonzero.alias("__first_nonzero"),
            last_observed.alias("__last_observed"),
        )
        .withColumn("status", status)
        .drop("__first_nonzero", "__last_observed")
    )


# Name of the column for NULL.
NULL_COLUMN = "NA"


def pivot_wide(
    df: DataFrame,
    ids: Sequence[str],
    col: str,
    value: str,
    values: Sequence[str] | None = None,
) -> DataFrame:
    """One column per value of ``col``, in the order of ``values``; NULL has the column ``NA``.

    One shuffle, on the ids, however many columns there are: rows are aggregated to cells, cells to one
    array per id, of which each column is an element. Without ``values`` one distinct job finds them, in
    text order, NULL last if there is any; an input without rows then gives the ids only. Two rows for
    one cell fail the job, and so does a value, or NULL, that is not in ``values``: to leave some out, filter first.
    """
    if values is None:
        found = [r[0] for r in df.select(as_col(col)).distinct().collect()]
        values = [*sorted(v for v in found if v is not None), *([None] if None in found else [])]
    values = list(values)
    names = [NULL_COLUMN if v is None else str(v) for v in values]
    if len(set(names)) < len(names):
        raise ValueError(f"two columns would have the same name: {sorted(n for n in set(names) if names.count(n) > 1)}")
    asked = F.concat(F.lit(f"no column was asked for {col} "), F.coalesce(as_col(col).cast("string"), F.lit("NULL")))
    place = F.raise_error(asked).cast("int")
    places = [x for n, v in enumerate(values) if v is not None for x in (F.lit(v).cast(df.schema[col].dataType), F.lit(n))]
    if places:
        place = F.coalesce(F.create_map(*places)[as_col(col)], place)
    if None in values:
        place = F.when(as_col(col).isNull(), F.lit(values.index(None))).otherwise(place)
    rows = df.select(*_cols(ids), place.alias("__place"), as_col(value).alias("__value"))
    # A cell is one row, so partial sums before the shuffle would only repeat them.
    rows = rows.repartition(*_cols(ids)) if ids else rows.coalesce(1)
    twice = F.raise_error(F.concat(F.lit("more than one row for a cell of column "), F.array(*map(F.lit, names))[F.col("__place")]))
    cell = F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.max("__value"))
    cells = rows.groupBy(*_cols(ids), "__place").agg(cell.alias("__value"))
    # Absent cells are filled in, then sorting puts each at its place.
    absent = F.array_except(F.sequence(F.lit(0), F.lit(len(names) - 1)), F.transform("__cells", lambda c: c["__place"]))
    none = F.lit(None).cast(df.schema[value].dataType)
    filled = F.transform(absent, lambda p: F.struct(p.alias("__place"), none.alias("__value")))
    wide = cells.groupBy(*_cols(ids)).agg(F.collect_list(F.struct("__place", "__value")).alias("__cells"))
    if not names:
        return wide.filter(F.size("__cells") >= 0).select(*_cols(ids))
    wide = wide.withColumn("__cells", F.array_sort(F.concat("__cells", filled)))
    return wide.select(*_cols(ids), *[F.col("__cells")[n]["__value"].alias(name) for n, name in enumerate(names)])


def pivot_database(
    df: DataFrame, ids: Sequence[str], col: str, value: str, values: Sequence[str] | None = None
) -> DataFrame:
    """Wide table with one column per database."""
    return pivot_wide(df, ids, col, value, values)


def pivot_estimates(df: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wide table with one column per estimate name."""
    return pivot_wide(df, ids, "estimate_name", "estimate_value", names)


# The four counts of an attrition step.
ATTRITION_COUNTS = ("number_records", "number_subjects", "excluded_records", "excluded_subjects")


def pivot_attrition(
    df: DataFrame, ids: Sequence[str], counts: Sequence[str] = ATTRITION_COUNTS
) -> DataFrame:
    """Attrition steps with one column per count and a numeric ``reason_id`` to order by."""
    wide = pivot_wide(df, ids, "variable_name", "estimate_value", counts)
    return wide.withColumn("reason_id", numbers.safe_cast("reason_id", "double"))
