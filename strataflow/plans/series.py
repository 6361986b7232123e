"""Model input of the interrupted time series, for every stratum and timepoint at once."""

from __future__ import annotations

from datetime import date
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import as_col
from ..operators.aggregates import monthly_rollup, quarterly_rollup
from ..operators.filters import complete_rows, drop_timepoint_row, monthly_subset
from ..operators.windows import at_timepoints, intervention_flag, time_index, trim_and_fill
from ..sources.bucketed import write_bucketed

STRATUM = (
    "database_name",
    "outcome_cohort_name",
    "denominator_age_group",
    "denominator_sex",
)
SERIES = (*STRATUM, "timepoint")

_DATE = "incidence_start_date"


def series_from_rollup(
    rolled: DataFrame,
    keys: Sequence[str] = STRATUM,
    timepoints: Sequence[date | str] = (),
    zero_sum_fill: float = 5.0,
) -> DataFrame:
    """Flag, cut and number rolled-up periods.

    Timepoints multiply the rolled-up rows, never the raw ones; both windows share one exchange, and
    need none on a rollup of :func:`write_rollup`.
    """
    series = [*keys, "timepoint"]
    timed = at_timepoints(rolled, timepoints)
    timed = intervention_flag(timed, _DATE, as_col("timepoint"))
    timed = drop_timepoint_row(timed, _DATE, as_col("timepoint"))
    return time_index(trim_and_fill(timed, series, zero_sum_fill), series, _DATE)


def sr_series_quarterly(
    df: DataFrame,
    keys: Sequence[str] = STRATUM,
    timepoints: Sequence[date | str] = (),
    na_event_fill: float = 1.0,
    zero_sum_fill: float = 5.0,
) -> DataFrame:
    """Quarterly counts, person-years, intervention flag and time index per series."""
    rolled = quarterly_rollup(monthly_subset(df), keys, na_event_fill)
    return series_from_rollup(rolled, keys, timepoints, zero_sum_fill)


def sr_series_monthly(
    df: DataFrame,
    keys: Sequence[str] = STRATUM,
    timepoints: Sequence[date | str] = (),
    na_event_fill: float = 1.0,
    zero_sum_fill: float = 5.0,
) -> DataFrame:
    """The same at month grain, quarter kept for the seasonal term."""
    rolled = monthly_rollup(monthly_subset(df), keys, na_event_fill)
    return series_from_rollup(rolled, keys, timepoints, zero_sum_fill)


def write_rollup(
    df: DataFrame,
    path: str,
    keys: Sequence[str] = STRATUM,
    period: str = "quarter",
    na_event_fill: float = 1.0,
    buckets: int = 200,
) -> None:
    """Roll up once and store the rows by series keys, to be read with ``sources.bucketed.read_bucketed``.

    Any choice of timepoints, models and residual checks then starts from the stored rows and moves none of them. A
    series has at most one row per ``period`` (``quarter`` or ``month``), so no bucket grows with a hot stratum.
    """
    rollups = {"quarter": quarterly_rollup, "month": monthly_rollup}
    rolled = rollups[period](monthly_subset(df), keys, na_event_fill)
    write_bucketed(rolled, path, keys, [_DATE], buckets)


# Names of forecast columns and models.
FORECAST_NAMES = {
    "denominator_age_group": "age_group",
    "denominator_sex": "sex",
    "outcome_cohort_name": "outcome",
    "timepoint": "timepoint",
    "database_name": "cdm_name",
}
RAW_MODEL = "Raw incidence"


def forecast_columns(forecast: Column, lower: Column, upper: Column, model: Column, when: Column) -> list[Column]:
    """The common layout of observed and modelled rates."""
    return [
        when.alias("Date"),
        forecast.alias("Forecast"),
        lower.alias("Lower_95_CI"),
        upper.alias("Upper_95_CI"),
        model.alias("Model"),
        *[as_col(old).alias(new) for old, new in FORECAST_NAMES.items()],
    ]


def raw_rate_series(df: DataFrame, timepoints: Sequence[date | str]) -> DataFrame:
    """Observed monthly rates with their bounds, in the layout of the forecasts."""
    observed = at_timepoints(complete_rows(monthly_subset(df), ["incidence"]), timepoints)
    return observed.select(
        *forecast_columns(
            as_col("incidence"),
            as_col("incidence_95CI_lower"),
            as_col("incidence_95CI_upper"),
            F.lit(RAW_MODEL),
            as_col(_DATE),
        )
    )
