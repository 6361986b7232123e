"""Policy index laid over monthly incidence."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from ..operators.aggregates import monthly_mean_index
from ..operators.filters import complete_rows
from ..operators.joins import join_covariate_month, lookup_country, scale_to_max
from ..operators.windows import rolling_mean_5
from ..sources.scratch import materialise

STRATUM = (
    "database_name",
    "outcome_cohort_name",
    "denominator_age_group",
    "denominator_sex",
)


def index_overlay(
    df: DataFrame,
    index: DataFrame,
    dim: DataFrame,
    smooth: bool = False,
    scale_keys: Sequence[str] = ("database_name",),
    series_keys: Sequence[str] = STRATUM,
    date_col: str = "incidence_start_date",
    rate: str = "incidence",
    written: bool = False,
) -> DataFrame:
    """Monthly incidence with the index of its country, on the scale of the rates.

    ``index`` is (country, date, si) by day, ``dim`` is (database, country). A month without an
    index gets 0. The scale, max(index) / max(rate) over ``scale_keys``, is taken before smoothing.
    ``series_keys`` separate the series that are smoothed, one row per month each.

    ``written`` puts the monthly means and the scales, small tables both, into the shared folder
    first: with their sizes known they are broadcast, and the rates are shuffled for smoothing only.
    For rates and an index that are stored tables; computed ones would be computed twice.
    """
    monthly = monthly_mean_index(complete_rows(index, ["country"]), ["country"], "date", "si")
    if written:
        monthly = materialise(monthly, "monthly")
    placed = lookup_country(df, dim)
    joined = join_covariate_month(
        placed, monthly, {"country": "country", date_col: "date"}, "si", 0.0
    )
    scaled = scale_to_max(
        complete_rows(joined, [rate]), "si", rate, scale_keys, written=written
    )
    if not smooth:
        return scaled
    bounds = [f"{rate}_95CI_lower", f"{rate}_95CI_upper"]
    return rolling_mean_5(scaled, series_keys, date_col, [rate, *bounds])
