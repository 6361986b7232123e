"""Ordered and group-relative columns.

True windows appear only over series that were rolled up to one row per calendar period, whose
length the calendar bounds. Anything over raw rows is an aggregate joined back.
"""

from __future__ import annotations

from datetime import date
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.missing import as_col, one_of
from .filters import _bound
from .joins import with_group_stats


def _series(keys: Sequence[str], date_col: str):
    return W.partitionBy(*[as_col(k) for k in keys]).orderBy(as_col(date_col))


def group_min_id(
    df: DataFrame, cols: Sequence[str], order: str, out: str = "group_id", written: bool | None = None
) -> DataFrame:
    """Smallest row id of the group a row belongs to. ``written``: see :func:`with_group_stats`."""
    return with_group_stats(df, cols, {out: F.min(as_col(order))}, written)


def complete_groups(
    df: DataFrame,
    cols: Sequence[str],
    names: Sequence[str],
    name_col: str = "estimate_name",
    written: bool | None = None,
) -> DataFrame:
    """Rows of the named estimates, in groups that hold each of them exactly once.

    ``written``: see :func:`with_group_stats`.
    """
    named = df.filter(one_of(name_col, names))
    counted = with_group_stats(
        named,
        cols,
        {"__n": F.count(F.lit(1)), "__names": F.count_distinct(as_col(name_col))},
        written,
    )
    full = (as_col("__n") == len(names)) & (as_col("__names") == len(names))
    return counted.filter(full).drop("__n", "__names")


def time_index(df: DataFrame, keys: Sequence[str], date_col: str, out: str = "time") -> DataFrame:
    """1, 2, 3, ... along each series."""
    return df.withColumn(out, F.row_number().over(_series(keys, date_col)))


def lagged_count(
    df: DataFrame, keys: Sequence[str], date_col: str, y: str, out: str = "lag_y"
) -> DataFrame:
    """Previous period's count."""
    return df.withColumn(out, F.lag(as_col(y), 1).over(_series(keys, date_col)))


def rolling_mean(
    df: DataFrame, keys: Sequence[str], date_col: str, cols: Sequence[str], k: int = 5
) -> DataFrame:
    """Centred moving mean of ``k`` points; NULL where fewer than ``k`` values are at hand."""
    half = (k - 1) // 2
    w = _series(keys, date_col).rowsBetween(-half, k - 1 - half)
    return df.withColumns(
        {c: F.when(F.count(as_col(c)).over(w) == k, F.avg(as_col(c)).over(w)) for c in cols}
    )


def rolling_mean_5(
    df: DataFrame, keys: Sequence[str], date_col: str, cols: Sequence[str], k: int = 5
) -> DataFrame:
    """Smooth a rate and its bounds; edge rows, where the first column is NULL, are dropped."""
    return rolling_mean(df, keys, date_col, cols, k).filter(as_col(cols[0]).isNotNull())


def trim_and_fill(
    df: DataFrame,
    keys: Sequence[str],
    zero_sum_fill: float = 5.0,
    date_col: str = "incidence_start_date",
    y: str = "n_events_sum",
    pt: str = "person_years_sum",
) -> DataFrame:
    """Drop leading all-zero periods and periods without person-time; later zeros become the fill.

    A series of zeros only disappears.
    """
    whole = W.partitionBy(*[as_col(k) for k in keys])
    first_nonzero = F.min(F.when(as_col(y) != 0, as_col(date_col))).over(whole)
    return (
        df.withColumn("__first_nonzero", first_nonzero)
        .filter((as_col(date_col) >= as_col("__first_nonzero")) & as_col(pt).isNotNull())
        .withColumn(y, F.when(as_col(y) == 0, F.lit(float(zero_sum_fill))).otherwise(as_col(y)))
        .drop("__first_nonzero")
    )


def nth_last_date(date_col: str, k: int, over=None) -> Column:
    """Aggregate: the k-th last distinct date of a group, or of a window; NULL when it has fewer.

    Only distinct dates are gathered, and the calendar bounds those.
    """
    dates = F.collect_set(as_col(date_col))
    return F.try_element_at(F.sort_array(dates if over is None else dates.over(over), asc=False), F.lit(k))


def drop_last_dates(
    df: DataFrame, keys: Sequence[str], date_col: str, k: int = 5, written: bool | None = None
) -> DataFrame:
    """Remove the rows of each series' last ``k`` distinct dates.

    ``written``: see :func:`with_group_stats`.
    """
    return (
        with_group_stats(df, keys, {"__cutoff": nth_last_date(date_col, k)}, written)
        .filter(as_col(date_col) < as_col("__cutoff"))
        .drop("__cutoff")
    )


def intervention_flag(
    df: DataFrame, date_col: str, timepoint: date | str | Column, out: str = "intrv"
) -> DataFrame:
    """1 from the timepoint on, 0 before."""
    return df.withColumn(
        out, F.when(as_col(date_col) >= _bound(timepoint), F.lit(1)).otherwise(F.lit(0))
    )


def at_timepoints(
    df: DataFrame, timepoints: Sequence[date | str], out: str = "timepoint"
) -> DataFrame:
    """Repeat each row once per listed timepoint (a short literal list)."""
    return df.withColumn(out, F.explode(F.array(*[_bound(t) for t in timepoints])))
