"""Estimates, attrition and snapshot tables as displayed, and chart data."""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.missing import as_col
from ..functions.text import LEVEL_SEPARATOR
from ..operators.aggregates import pivot_attrition
from ..operators.filters import attrition_filter, multi_filter
from ..operators.projections import (
    alias_recode,
    drop_constant_settings,
    relocate_columns,
    rename_display,
)
from ..operators.summarised import split_all
from ..sources.dims import DATABASE_ALIASES

# ---- Fixed values: settings that are not shown, and display names ---------------------------
ESTIMATE_SETTINGS = (
    "analysis_id",
    "analysis_complete_database_intervals",
    "denominator_start_date",
    "denominator_end_date",
    "cohort_obscured",
    "analysis_outcome_washout",
    "result_obscured",
    "outcome_cohort_id",
    "analysis_repeated_events",
    "denominator_cohort_id",
    "analysis_min_cell_count",
    "denominator_cohort_name",
    "denominator_target_cohort_definition_id",
    "denominator_target_cohort_name",
)

ESTIMATE_HIDDEN = (
    "incidence_95CI_lower",
    "incidence_95CI_upper",
    "denominator_days_prior_observation",
    "time_at_risk",
    "year_index",
    "month_index",
    "year_month",
)

ESTIMATE_NAMES = {
    "incidence_start_date": "Start Date",
    "incidence_end_date": "End Date",
    "n_persons": "Persons (n)",
    "person_years": "Person Years",
    "n_events": "Events (n)",
    "incidence": "Incidence (100000 pys)",
    "outcome_cohort_name": "Outcome",
    "analysis_interval": "Time Interval",
    "denominator_age_group": "Age",
    "denominator_sex": "Sex",
    "database_name": "Database",
}

ATTRITION_SETTINGS = (
    "analysis_id",
    "analysis_repeated_events",
    "analysis_outcome_washout",
    "analysis_complete_database_intervals",
    "denominator_target_cohort_definition_id",
    "denominator_target_cohort_name",
    "denominator_start_date",
    "denominator_end_date",
)

ATTRITION_HIDDEN = (
    "reason_id",
    "outcome_cohort_id",
    "denominator_cohort_id",
    "denominator_cohort_name",
    "denominator_days_prior_observation",
    "analysis_min_cell_count",
)

ATTRITION_NAMES = {
    "number_records": "Number records",
    "number_subjects": "Number subjects",
    "excluded_records": "Excluded records",
    "excluded_subjects": "Excluded subjects",
    "reason": "Reason",
    "outcome_cohort_name": "Outcome",
    "denominator_age_group": "Age",
    "denominator_sex": "Sex",
    "analysis_interval": "Time Interval",
    "cdm_name": "Database",
}

SNAPSHOT_HIDDEN = ("cdm_source_name", "cdm_description")
# ---- End of fixed values --------------------------------------------------------------------


def estimates_view(
    df: DataFrame,
    selection: Mapping[str, Iterable],
    settings: Sequence[str] = ESTIMATE_SETTINGS,
) -> DataFrame:
    """Selected estimates without the settings that never vary."""
    return drop_constant_settings(multi_filter(df, selection), settings)


def estimates_display(
    df: DataFrame,
    selection: Mapping[str, Iterable],
    settings: Sequence[str] = ESTIMATE_SETTINGS,
    hidden: Sequence[str] = ESTIMATE_HIDDEN,
) -> DataFrame:
    """The estimates table as shown: display text, display names, display order.

    A missing number is shown as ``NA``, so a missing rate reads ``NA (NA to NA)``.
    """
    shown = estimates_view(df, selection, settings)

    def rate(c: str) -> Column:
        return numbers.grouped_number(c, 2, na_text="NA")

    columns = {
        "incidence": F.concat(
            rate("incidence"),
            F.lit(" ("),
            rate("incidence_95CI_lower"),
            F.lit(" to "),
            rate("incidence_95CI_upper"),
            F.lit(")"),
        )
    }
    for c in ("n_persons", "n_events", "person_years"):
        columns[c] = numbers.grouped_number(c, 0, na_text="NA")
    shown = drop_constant_settings(shown.withColumns(columns), hidden)
    shown = relocate_columns(shown, ["incidence_start_date"])
    shown = relocate_columns(shown, ["incidence_end_date"], after="incidence_start_date")
    shown = relocate_columns(shown, ["person_years"], after="n_persons")
    return rename_display(shown, ESTIMATE_NAMES)


def attrition_display(
    df: DataFrame,
    selection: Mapping[str, Iterable],
    settings: Sequence[str] = ATTRITION_SETTINGS,
    hidden: Sequence[str] = ATTRITION_HIDDEN,
    aliases: Mapping[str, str] = DATABASE_ALIASES,
) -> DataFrame:
    """The attrition table as shown. Database aliases apply here too, so selections match."""
    shown = attrition_filter(alias_recode(df, "cdm_name", aliases), selection)
    shown = drop_constant_settings(shown, [*settings, *hidden])
    shown = rename_display(shown, {k: v for k, v in ATTRITION_NAMES.items() if k in shown.columns})
    return relocate_columns(shown, ["Reason"], before="Outcome")


def attrition_flow(
    df: DataFrame,
    keys: Sequence[str] = ("cdm_name", "cohort_name"),
    columns: Mapping[str, Sequence[str]] | None = None,
    separator: str = LEVEL_SEPARATOR,
    known: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Flow of every cohort: a node per step, with what is lost on the way to the next step.

    Input is a summarised result whose strata hold ``reason`` and whose additional pair holds
    ``reason_id``; ``columns`` lists other parts where there are some, and a part not listed fails the
    job. A reason that holds `` and `` is split there, which fails too: give ``separator=" &&& "`` or
    ``known={}`` (:func:`.split_name_level`) for such results. Steps of one cohort are few, so the window over a cohort stays small.
    """
    parts = columns or {
        "group": ["cohort_name"],
        "strata": ["reason"],
        "additional": ["reason_id"],
    }
    typed = df.withColumn("additional_level", as_col("additional_level").cast("string"))
    split = split_all(typed, columns=parts, separator=separator, known=known)
    wide = pivot_attrition(split, [*keys, "reason_id", "reason"])
    steps = W.partitionBy(*[as_col(k) for k in keys]).orderBy("reason_id")
    return wide.withColumns(
        {
            "step": F.row_number().over(steps),
            "lost_records": F.lead("excluded_records").over(steps),
            "lost_subjects": F.lead("excluded_subjects").over(steps),
            "next_reason": F.lead("reason").over(steps),
        }
    )


def snapshot_view(
    df: DataFrame,
    aliases: Mapping[str, str] = DATABASE_ALIASES,
    hidden: Sequence[str] = SNAPSHOT_HIDDEN,
) -> DataFrame:
    """Database snapshot as shown."""
    shown = df.withColumn("cdm_version", as_col("cdm_version").cast("string"))
    return drop_constant_settings(alias_recode(shown, "cdm_name", aliases), hidden)


def plot_series(
    df: DataFrame,
    x: str,
    group_cols: Sequence[str] = (),
    facet_cols: Sequence[str] = (),
    ci: bool = True,
    y: str = "incidence",
) -> DataFrame:
    """Tidy chart data: x, rate, optional bounds, and keys for colour and facet.

    One function for every combination of grouping, facetting and error bars; scales are the
    renderer's business.
    """
    out = [as_col(x).alias("x"), as_col(y).alias("y")]
    if ci:
        out += [as_col(f"{y}_95CI_lower").alias("ymin"), as_col(f"{y}_95CI_upper").alias("ymax")]
    if group_cols:
        out.append(text.united(group_cols).alias("Group"))
    if facet_cols:
        out.append(text.united(facet_cols).alias("facet_var"))
    return df.select(*out)
