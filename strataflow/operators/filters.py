"""Row filters. All are plain predicates, so they reach the scan where the source allows it."""

from __future__ import annotations

from datetime import date
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import as_col, one_of, matches


def _as_date(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def multi_filter(
    df: DataFrame, selection: Mapping[str, Iterable], date_cols: Sequence[str] = ("incidence_start_date",)
) -> DataFrame:
    """Keep rows whose every listed column is in its selected set.

    Dates may be given as ISO text; they are compared as dates, so the predicate still prunes files.
    """
    for col, values in selection.items():
        if col in date_cols:
            values = [None if v is None else _as_date(v) for v in values]
        df = df.filter(one_of(col, values))
    return df


def attrition_filter(df: DataFrame, selection: Mapping[str, Iterable]) -> DataFrame:
    return multi_filter(df, selection)


def monthly_subset(
    df: DataFrame,
    selection: Mapping[str, Iterable] | None = None,
    interval: str = "months",
    interval_col: str = "analysis_interval",
) -> DataFrame:
    """Membership filter within one analysis interval."""
    return multi_filter(df.filter(as_col(interval_col) == interval), selection or {})


def equality_filter(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(as_col(col) == F.lit(value))


def estimate_whitelist(df: DataFrame, types: Iterable[str], names: Iterable[str]) -> DataFrame:
    return df.filter(one_of("estimate_type", types) & one_of("estimate_name", names))


def country_whitelist(df: DataFrame, col: str, countries: Iterable[str]) -> DataFrame:
    return df.filter(one_of(col, countries))


def quality_cutoff(
    df: DataFrame, name_col: str, pattern: str, date_col: str, cutoff: date | str
) -> DataFrame:
    """Drop rows of matching names dated after the cutoff.

    A matching name with no date is dropped too: its condition is neither true nor false.
    """
    return df.filter(~(matches(name_col, pattern) & (as_col(date_col) > F.lit(_as_date(cutoff)))))


def double_regex_drop(df: DataFrame, c1: str, p1: str, c2: str, p2: str) -> DataFrame:
    """Drop rows in which both columns match."""
    return df.filter(~(matches(c1, p1) & matches(c2, p2)))


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = df.filter(as_col(c).isNotNull())
    return df


# Fixed value: outcomes that exist only after the event under study.
POST_EVENT_PATTERN = "COVID-19"


def outcome_gate(df: DataFrame, col: str, pattern: str = POST_EVENT_PATTERN) -> DataFrame:
    """Keep outcomes for which a comparison with the time before the event is possible."""
    return df.filter(~matches(col, pattern))


def _bound(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(_as_date(value))


def pre_period(df: DataFrame, date_col: str, timepoint: date | str | Column) -> DataFrame:
    """Rows up to and including the timepoint (a date, ISO text or a column)."""
    return df.filter(as_col(date_col) <= _bound(timepoint))


def drop_timepoint_row(df: DataFrame, date_col: str, timepoint: date | str | Column) -> DataFrame:
    """Remove the period that starts exactly at the timepoint."""
    return df.filter(as_col(date_col) != _bound(timepoint))
