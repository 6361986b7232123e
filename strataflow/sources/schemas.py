"""Declared schemas of the result tables. Nothing is inferred when files are read."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_S, _I, _D, _B, _DATE = (
    T.StringType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.DateType(),
)

# Analysis and cohort keys shared by estimates and attrition.
_ANALYSIS = dict(
    analysis_id=_I,
    analysis_interval=_S,
    analysis_complete_database_intervals=_B,
    analysis_repeated_events=_B,
    analysis_outcome_washout=_S,
    analysis_min_cell_count=_I,
    outcome_cohort_id=_I,
    outcome_cohort_name=_S,
    denominator_cohort_id=_I,
    denominator_cohort_name=_S,
    denominator_target_cohort_definition_id=_I,
    denominator_target_cohort_name=_S,
    denominator_start_date=_DATE,
    denominator_end_date=_DATE,
    denominator_age_group=_S,
    denominator_sex=_S,
    denominator_days_prior_observation=_I,
    cdm_name=_S,
)

INCIDENCE_ESTIMATES = _schema(
    **_ANALYSIS,
    incidence_start_date=_DATE,
    incidence_end_date=_DATE,
    n_persons=_D,
    n_events=_D,
    person_years=_D,
    incidence_100000_pys=_D,
    incidence_100000_pys_95CI_lower=_D,
    incidence_100000_pys_95CI_upper=_D,
    cohort_obscured=_B,
    result_obscured=_B,
)

INCIDENCE_ATTRITION = _schema(
    **_ANALYSIS,
    reason_id=_I,
    reason=_S,
    number_records=_D,
    number_subjects=_D,
    excluded_records=_D,
    excluded_subjects=_D,
)

SUMMARISED_RESULT = _schema(
    result_id=_I,
    cdm_name=_S,
    group_name=_S,
    group_level=_S,
    strata_name=_S,
    strata_level=_S,
    variable_name=_S,
    variable_level=_S,
    estimate_name=_S,
    estimate_type=_S,
    estimate_value=_S,
    additional_name=_S,
    additional_level=_S,
)

SNAPSHOT = _schema(
    cdm_name=_S,
    cdm_source_name=_S,
    cdm_description=_S,
    cdm_version=_S,
    vocabulary_version=_S,
    snapshot_date=_S,
)

COVARIATE_CASES = _schema(month=_I, year=_I, cases=_D, countriesAndTerritories=_S)
