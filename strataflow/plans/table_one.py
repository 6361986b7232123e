"""Baseline characteristics table."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.missing import as_col
from ..operators.aggregates import pivot_database
from ..operators.filters import double_regex_drop, equality_filter, estimate_whitelist
from ..operators.joins import left_join_attributes
from ..operators.projections import (
    alias_recode,
    label_recode,
    regex_recode,
    rename_display,
    variable_label,
)
from ..operators.summarised import format_estimates, split_all
from ..sources.dims import DATABASE_ALIASES, OUTCOME_LABELS

# ---- Fixed values -----------------------------------------------------------------------
TABLE_ONE_TYPES = ("integer", "numeric")
TABLE_ONE_ESTIMATES = ("count", "percentage", "mean", "min", "max")
TABLE_ONE_TEMPLATES = ("<count>", "<mean> (<min> to <max>)")
ALL_POPULATION = "All population"
COHORT_NAMES = {"denominator_sex": "Sex", "denominator_age_group": "Age group"}
# ---- End of fixed values ----------------------------------------------------------------


def table_one(
    df: DataFrame,
    cohorts: DataFrame,
    labels: Mapping[str, str] = OUTCOME_LABELS,
    aliases: Mapping[str, str] = DATABASE_ALIASES,
    databases: Sequence[str] | None = None,
    columns: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Summarised result to one row per outcome, stratum and variable, one column per database.

    ``cohorts`` holds denominator_cohort_name, denominator_sex and denominator_age_group.
    ``databases`` and ``columns`` (see ``split_all``) declare the data-dependent columns; leaving
    them out costs one distinct job each. A row without a database goes to the column ``NA``. An input
    without rows gives a table without rows.
    """
    kept = estimate_whitelist(
        alias_recode(df, "cdm_name", aliases), TABLE_ONE_TYPES, TABLE_ONE_ESTIMATES
    )
    value = as_col("estimate_value")
    rounded = numbers.plain_number(numbers.safe_cast(value, "double"), 2)
    formatted = format_estimates(
        kept.withColumn("estimate_value", F.when(value.isNotNull(), rounded)),
        TABLE_ONE_TEMPLATES,
        keep_unformatted=False,
        template_order=False,
        known_names=TABLE_ONE_ESTIMATES,
    )
    split = split_all(formatted, columns=columns)
    if "cohort_name" not in split.columns and split.isEmpty():
        split = split.withColumn("cohort_name", F.lit(None).cast("string"))
    named = variable_label(split, "variable_name", "variable_level")
    named = rename_display(
        named.drop("variable_level", "estimate_type", "estimate_name"),
        {"cdm_name": "Database", "cohort_name": "Outcome", "variable_name": "Variable"},
    )
    ids = [c for c in named.columns if c not in ("Database", "estimate_value")]
    wide = pivot_database(named, ids, "Database", "estimate_value", databases)
    # Spark names ignore case: a stratum column called like a cohort attribute is told apart.
    taken = {n.lower() for n in COHORT_NAMES.values()}
    wide = rename_display(wide, {c: f"{c} (stratum)" for c in wide.columns if c.lower() in taken})
    wide = left_join_attributes(wide, cohorts, "Outcome", "denominator_cohort_name")
    wide = rename_display(wide, COHORT_NAMES)
    wide = regex_recode(wide, "Outcome", "denominator", ALL_POPULATION).drop("result_id")
    wide = double_regex_drop(wide, "Variable", "Sex", "Outcome", "population")
    return label_recode(wide, "Outcome", labels)


def table_one_view(df: DataFrame, outcome: str = ALL_POPULATION) -> DataFrame:
    """The part of table one that is shown."""
    return equality_filter(df, "Outcome", outcome)
