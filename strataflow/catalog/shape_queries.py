"""Registered queries: joins, aggregates, windows, summarised results, displayed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, filters, joins, summarised, windows
from ..operators.projections import null_default, rename_display, stamp
from ..plans import covariates, incidence, table_one as table_one_plan
from ..plans.lake import RATE_NAMES
from ..plans.series import STRATUM
from ..sources import dims
from . import fixtures as fx
from .registry import query
from .tidy_queries import PRIORITY_LABELS, REGION_COUNTRY

STRATUM_SQL = ", ".join(STRATUM)
DATABASES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PARTS = {"group": ["cohort_name"], "strata": ["age_group", "sex"], "additional": []}


def tidy_rates(spark, d, persons=True):
    return rename_display(fx.rates(spark, d, persons), RATE_NAMES)


TIDY_SQL = """(SELECT * RENAME (incidence_100000_pys AS incidence, incidence_100000_pys_95CI_lower AS incidence_95CI_lower,
    incidence_100000_pys_95CI_upper AS incidence_95CI_upper) FROM fx_rates)"""

COUNTRY_SQL = "CASE WHEN database_name <> 'MIDDLE EAST' THEN database_name END"
MONTHLY_SQL = """(SELECT country, CAST(date_trunc('month', date) AS DATE) AS date,
    CASE WHEN COUNT(si) = COUNT(*) THEN AVG(si) END AS si FROM fx_index GROUP BY country, date_trunc('month', date))"""


def country_dim(spark):
    return dims.mapping_table(spark, REGION_COUNTRY, "database", "country")


# ---- joins --------------------------------------------------------------------------------


@query(
    "left_join_attributes",
    """SELECT c.*, a.denominator_sex, a.denominator_age_group
    FROM (SELECT * REPLACE (nullif(group_level, '5-LOW') AS group_level) FROM fx_characterisation) c LEFT JOIN
    (SELECT DISTINCT denominator_cohort_name, denominator_sex, denominator_age_group FROM fx_rates
     UNION ALL SELECT NULL, 'unknown', NULL) a
    ON c.group_level IS NOT DISTINCT FROM a.denominator_cohort_name""",
)
def left_join_attributes(spark, d):
    """NULL keys on both sides match each other."""
    rows = fx.characterisation(spark, d).withColumn("group_level", F.nullif("group_level", F.lit("5-LOW")))
    unknown = spark.sql("SELECT cast(NULL AS string) denominator_cohort_name, 'unknown' denominator_sex, cast(NULL AS string) denominator_age_group")
    attributes = cohorts(spark, d).unionByName(unknown)
    return joins.left_join_attributes(rows, attributes, "group_level", "denominator_cohort_name")


def cohorts(spark, d):
    return aggregates.distinct_cohorts(
        fx.rates(spark, d, persons=False),
        ["denominator_cohort_name", "denominator_sex", "denominator_age_group"],
    )


@query(
    "join_covariate_month",
    f"""SELECT {STRATUM_SQL}, f.country, f.incidence_start_date, round(coalesce(m.si, 0), 9) AS si
    FROM (SELECT *, {COUNTRY_SQL} AS country FROM fx_incidence) f LEFT JOIN {MONTHLY_SQL} m
    ON f.country = m.country AND f.incidence_start_date = m.date""",
)
def join_covariate_month(spark, d):
    placed = joins.lookup_country(fx.incidence(spark, d, persons=False), country_dim(spark))
    monthly = aggregates.monthly_mean_index(fx.index(spark, d))
    out = joins.join_covariate_month(
        placed, monthly, {"country": "country", "incidence_start_date": "date"}
    )
    return out.select(*STRATUM, "country", "incidence_start_date", F.round("si", 9).alias("si"))


@query(
    "join_order_table",
    """SELECT s.*, o.format_id FROM fx_summarised s
    LEFT JOIN (VALUES ('mean', 1), ('count', 2)) o(estimate_name, format_id) ON s.estimate_name = o.estimate_name""",
)
def join_order_table(spark, d):
    order = dims.mapping_table(spark, {"mean": 1, "count": 2}, "estimate_name", "format_id")
    return joins.join_order_table(fx.summarised(spark, d), order, "estimate_name")


@query(
    "null_safe_anti_join",
    """SELECT * FROM fx_summarised s WHERE NOT EXISTS (SELECT 1 FROM fx_summarised t
    WHERE t.cdm_name IN ('ASIA', 'EUROPE') AND t.estimate_name IN ('mean', 'count')
    AND s.cdm_name IS NOT DISTINCT FROM t.cdm_name AND s.group_level IS NOT DISTINCT FROM t.group_level
    AND s.variable_level IS NOT DISTINCT FROM t.variable_level AND s.estimate_name IS NOT DISTINCT FROM t.estimate_name)""",
)
def null_safe_anti_join(spark, d):
    df = fx.summarised(spark, d)
    gone = df.filter(
        F.col("cdm_name").isin("ASIA", "EUROPE") & F.col("estimate_name").isin("mean", "count")
    )
    return joins.null_safe_anti_join(
        df, gone, ["cdm_name", "group_level", "variable_level", "estimate_name"]
    )


@query("lookup_country", f"SELECT *, {COUNTRY_SQL} AS country FROM fx_incidence")
def lookup_country(spark, d):
    return joins.lookup_country(fx.incidence(spark, d), country_dim(spark))


@query(
    "scale_to_max",
    f"""SELECT {STRATUM_SQL}, incidence_start_date, round(n_persons / (MAX(n_persons) OVER w / MAX(incidence) OVER w), 8) AS scaled
    FROM {TIDY_SQL} WHERE incidence IS NOT NULL WINDOW w AS (PARTITION BY database_name)""",
)
def scale_to_max(spark, d):
    df = filters.complete_rows(tidy_rates(spark, d), ["incidence"])
    out = joins.scale_to_max(df, "n_persons", "incidence", ["database_name"], "scaled")
    return out.select(*STRATUM, "incidence_start_date", F.round("scaled", 8).alias("scaled"))


# ---- aggregates ---------------------------------------------------------------------------


@query(
    "distinct_cohorts",
    "SELECT DISTINCT denominator_cohort_name, denominator_sex, denominator_age_group FROM fx_rates",
)
def distinct_cohorts(spark, d):
    return cohorts(spark, d)


@query(
    "facet_domains",
    """SELECT DISTINCT 'database_name' AS "column", database_name AS value FROM fx_rates
    UNION ALL SELECT DISTINCT 'denominator_sex', denominator_sex FROM fx_rates
    UNION ALL SELECT DISTINCT 'outcome_cohort_name', outcome_cohort_name FROM fx_rates
    UNION ALL SELECT DISTINCT 'denominator_target_cohort_name', denominator_target_cohort_name FROM fx_rates
    UNION ALL SELECT DISTINCT 'incidence_start_date', CAST(incidence_start_date AS VARCHAR) FROM fx_rates""",
)
def facet_domains(spark, d):
    return aggregates.facet_domains(
        fx.rates(spark, d, persons=False),
        [
            "database_name",
            "denominator_sex",
            "outcome_cohort_name",
            "denominator_target_cohort_name",
            "incidence_start_date",
        ],
    )


@query(
    "monthly_sum_country",
    """SELECT CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, country,
    CASE WHEN COUNT(si) = COUNT(*) THEN CAST(SUM(CAST(si AS DECIMAL(28,4))) AS DOUBLE) END AS cases
    FROM fx_index GROUP BY month(date), year(date), country""",
)
def monthly_sum_country(spark, d):
    daily = fx.index(spark, d).select(
        F.month("date").alias("month"), F.year("date").alias("year"), "country", F.col("si").alias("cases")
    )
    return aggregates.monthly_sum_country(daily).withColumn("cases", F.round("cases", 4))


@query("monthly_mean_index", f"SELECT country, date, round(si, 9) AS si FROM {MONTHLY_SQL}")
def monthly_mean_index(spark, d):
    return aggregates.monthly_mean_index(fx.index(spark, d)).withColumn("si", F.round("si", 9))


@query("quarterly_rollup", "SELECT * FROM fx_quarterly")
def quarterly_rollup(spark, d):
    out = aggregates.quarterly_rollup(fx.incidence(spark, d, persons=False), STRATUM)
    return out.withColumn("person_years_sum", F.round("person_years_sum", 5))


@query("monthly_rollup", "SELECT * FROM fx_monthly")
def monthly_rollup(spark, d):
    out = aggregates.monthly_rollup(fx.incidence(spark, d, persons=False), STRATUM)
    return out.withColumn("person_years_sum", F.round("person_years_sum", 5))


@query(
    "max_and_argmax",
    """SELECT r.database_name, r.outcome_cohort_name, m.top AS max_incidence,
    MIN(CASE WHEN r.incidence = m.top THEN r.incidence_start_date END) AS incidence_start_date_at_max
    FROM """ + TIDY_SQL + """ r JOIN (SELECT database_name, outcome_cohort_name, MAX(incidence) AS top
      FROM """ + TIDY_SQL + """ GROUP BY 1, 2) m
    ON r.database_name = m.database_name AND r.outcome_cohort_name = m.outcome_cohort_name GROUP BY 1, 2, 3""",
)
def max_and_argmax(spark, d):
    return aggregates.max_and_argmax(
        tidy_rates(spark, d, persons=False), "incidence", "incidence_start_date", ["database_name", "outcome_cohort_name"]
    )


@query(
    "series_counts",
    """SELECT database_name, denominator_target_cohort_name, COUNT(*) AS n, COUNT(DISTINCT outcome_cohort_name) AS n_distinct
    FROM fx_rates GROUP BY 1, 2""",
)
def series_counts(spark, d):
    return aggregates.series_counts(
        fx.rates(spark, d, persons=False), ["database_name", "denominator_target_cohort_name"], "outcome_cohort_name"
    )


@query(
    "series_status",
    f"""WITH f AS (SELECT {STRATUM_SQL}, COUNT(*) AS n_rows, MIN(CASE WHEN n_events_sum <> 0 THEN incidence_start_date END) AS a,
      MAX(CASE WHEN person_years_sum IS NOT NULL THEN incidence_start_date END) AS b FROM fx_quarterly GROUP BY ALL)
    SELECT {STRATUM_SQL}, n_rows, CASE WHEN regexp_matches(outcome_cohort_name, 'URGENT') THEN 'post_event_outcome'
      WHEN a IS NULL OR b IS NULL OR b < a THEN 'no_records' ELSE 'ok' END AS status FROM f""",
)
def series_status(spark, d):
    rolled = aggregates.quarterly_rollup(fx.incidence(spark, d, persons=False), STRATUM)
    return aggregates.series_status(rolled, STRATUM, pattern="URGENT")


def _pivot_sql(values, col, value):
    return ", ".join(f"MAX(CASE WHEN {col} = '{v}' THEN {value} END) AS \"{v}\"" for v in values)


WHITELISTED_SQL = "(SELECT * FROM fx_summarised WHERE estimate_type IN ('integer', 'numeric'))"


def whitelisted(spark, d):
    return filters.estimate_whitelist(
        fx.summarised(spark, d), table_one_plan.TABLE_ONE_TYPES, table_one_plan.TABLE_ONE_ESTIMATES
    )


@query(
    "pivot_database",
    f"""SELECT group_level, strata_level, variable_name, variable_level, estimate_name,
    {_pivot_sql(DATABASES, "cdm_name", "estimate_value")} FROM {WHITELISTED_SQL} GROUP BY 1, 2, 3, 4, 5""",
)
def pivot_database(spark, d):
    return aggregates.pivot_database(
        whitelisted(spark, d),
        ["group_level", "strata_level", "variable_name", "variable_level", "estimate_name"],
        "cdm_name",
        "estimate_value",
        DATABASES,
    )


# A database that is empty in some file has a column of its own.
@query(
    "pivot_null_database",
    f"""SELECT group_level, strata_level, variable_name, variable_level, estimate_name,
    {_pivot_sql([x for x in DATABASES if x != "ASIA"], "cdm_name", "estimate_value")},
    MAX(CASE WHEN cdm_name = 'ASIA' THEN estimate_value END) AS "NA" FROM {WHITELISTED_SQL} GROUP BY 1, 2, 3, 4, 5""",
)
def pivot_null_database(spark, d):
    given = whitelisted(spark, d).withColumn("cdm_name", F.nullif("cdm_name", F.lit("ASIA")))
    ids = ["group_level", "strata_level", "variable_name", "variable_level", "estimate_name"]
    return aggregates.pivot_database(given, ids, "cdm_name", "estimate_value")


ROW_IDS = ["cdm_name", "group_level", "strata_name", "strata_level", "variable_name", "variable_level"]
ROW_IDS_SQL = ", ".join(ROW_IDS)
NAMES = ["count", "mean", "min", "max"]


@query(
    "pivot_estimates",
    f"SELECT {ROW_IDS_SQL}, {_pivot_sql(NAMES, 'estimate_name', 'estimate_value')} FROM {WHITELISTED_SQL} GROUP BY ALL",
)
def pivot_estimates(spark, d):
    return aggregates.pivot_estimates(whitelisted(spark, d), ROW_IDS, NAMES)


@query(
    "pivot_attrition",
    """SELECT cdm_name, outcome_cohort_name AS cohort_name, CAST(reason_id AS DOUBLE) AS reason_id, reason,
    CAST(number_records AS VARCHAR) AS number_records, CAST(number_subjects AS VARCHAR) AS number_subjects,
    CAST(excluded_records AS VARCHAR) AS excluded_records, CAST(excluded_subjects AS VARCHAR) AS excluded_subjects
    FROM fx_attrition""",
)
def pivot_attrition(spark, d):
    split = summarised.split_all(
        fx.attrition_long(spark, d).withColumn("additional_level", F.col("additional_level").cast("string")),
        columns={"group": ["cohort_name"], "strata": ["reason"], "additional": ["reason_id"]},
    )
    return aggregates.pivot_attrition(split, ["cdm_name", "cohort_name", "reason_id", "reason"])


# ---- windows ------------------------------------------------------------------------------


@query(
    "group_min_id",
    """SELECT o_orderkey, o_custkey, o_orderstatus, MIN(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS group_id
    FROM orders""",
)
def group_min_id(spark, d):
    df = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return windows.group_min_id(df, ["o_custkey", "o_orderstatus"], "o_orderkey")


@query(
    "complete_groups",
    f"""SELECT * FROM fx_summarised WHERE estimate_name IN ('mean', 'min', 'max')
    QUALIFY COUNT(*) OVER (PARTITION BY {ROW_IDS_SQL}) = 3
    AND COUNT(DISTINCT estimate_name) OVER (PARTITION BY {ROW_IDS_SQL}) = 3""",
)
def complete_groups(spark, d):
    return windows.complete_groups(fx.summarised(spark, d), ROW_IDS, ["mean", "min", "max"])


_W = f"OVER (PARTITION BY {STRATUM_SQL} ORDER BY incidence_start_date"


@query("time_index", f"SELECT *, CAST(ROW_NUMBER() {_W}) AS INTEGER) AS time FROM fx_incidence")
def time_index(spark, d):
    return windows.time_index(fx.incidence(spark, d), STRATUM, "incidence_start_date")


@query("lagged_count", f"SELECT *, LAG(n_events) {_W}) AS lag_y FROM fx_incidence")
def lagged_count(spark, d):
    return windows.lagged_count(fx.incidence(spark, d), STRATUM, "incidence_start_date", "n_events")


def _rolling_sql(c):
    w = f"{_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
    return f"CASE WHEN COUNT({c}) {w} = 5 THEN round(AVG({c}) {w}, 6) END AS {c}"


RATE_COLUMNS = ["incidence", "incidence_95CI_lower", "incidence_95CI_upper"]


@query(
    "rolling_mean_5",
    f"""SELECT * FROM (SELECT {STRATUM_SQL}, incidence_start_date, {", ".join(map(_rolling_sql, RATE_COLUMNS))}
    FROM {TIDY_SQL}) WHERE incidence IS NOT NULL""",
)
def rolling_mean_5(spark, d):
    df = tidy_rates(spark, d, persons=False).select(*STRATUM, "incidence_start_date", *RATE_COLUMNS)
    out = windows.rolling_mean_5(df, STRATUM, "incidence_start_date", RATE_COLUMNS)
    return out.withColumns({c: F.round(c, 6) for c in RATE_COLUMNS})


@query(
    "trim_and_fill",
    f"""SELECT * EXCLUDE (a) REPLACE (CASE WHEN n_events_sum = 0 THEN 5.0 ELSE n_events_sum END AS n_events_sum)
    FROM (SELECT *, MIN(CASE WHEN n_events_sum <> 0 THEN incidence_start_date END) OVER (PARTITION BY {STRATUM_SQL}) AS a
      FROM fx_quarterly) WHERE incidence_start_date >= a AND person_years_sum IS NOT NULL""",
)
def trim_and_fill(spark, d):
    rolled = aggregates.quarterly_rollup(fx.incidence(spark, d, persons=False), STRATUM)
    out = windows.trim_and_fill(rolled, STRATUM)
    return out.withColumn("person_years_sum", F.round("person_years_sum", 5))


@query(
    "drop_last_5_dates",
    f"""SELECT * EXCLUDE (r) FROM (SELECT *, dense_rank() OVER (PARTITION BY database_name, outcome_cohort_name
    ORDER BY incidence_start_date DESC) AS r FROM fx_incidence) WHERE r > 5""",
)
def drop_last_5_dates(spark, d):
    return windows.drop_last_dates(
        fx.incidence(spark, d), ["database_name", "outcome_cohort_name"], "incidence_start_date"
    )


@query(
    "intervention_flag",
    """SELECT f.*, p.timepoint, CAST(CASE WHEN incidence_start_date >= p.timepoint THEN 1 ELSE 0 END AS INTEGER) AS intrv
    FROM fx_incidence f, (SELECT DATE '1998-03-01' AS timepoint UNION ALL SELECT DATE '1998-04-01') p""",
)
def intervention_flag(spark, d):
    timed = windows.at_timepoints(fx.incidence(spark, d), fx.TIMEPOINTS)
    return windows.intervention_flag(timed, "incidence_start_date", F.col("timepoint"))


# ---- summarised results -------------------------------------------------------------------

IDS_SQL = """result_id, cdm_name, group_name, group_level, strata_name, strata_level, variable_name, variable_level,
    additional_name, additional_level"""
GROUPED_SQL = f"""(SELECT {IDS_SQL}, COUNT(*) FILTER (estimate_name = 'count') AS n_count,
    COUNT(*) FILTER (estimate_name = 'mean') AS n_mean, COUNT(*) FILTER (estimate_name = 'min') AS n_min,
    COUNT(*) FILTER (estimate_name = 'max') AS n_max,
    {_pivot_sql(NAMES, "estimate_name", "estimate_value")} FROM fx_summarised GROUP BY ALL)"""
TEMPLATES = ("<count>", "<mean> (<min> to <max>)", "<median>")


@query(
    "format_estimates",
    f"""WITH g AS {GROUPED_SQL}
    SELECT {IDS_SQL}, 'count' AS estimate_name, 'character' AS estimate_type, "count" AS estimate_value, 1 AS format_id
    FROM g WHERE n_count = 1
    UNION ALL SELECT {IDS_SQL}, 'mean (min to max)', 'character', "mean" || ' (' || "min" || ' to ' || "max" || ')', 2
    FROM g WHERE n_mean = 1 AND n_min = 1 AND n_max = 1
    UNION ALL SELECT {", ".join("s." + c.strip() for c in IDS_SQL.split(","))}, s.estimate_name, s.estimate_type, s.estimate_value,
      CASE WHEN s.estimate_name = 'count' THEN 1 ELSE 4 END
    FROM fx_summarised s JOIN g ON {" AND ".join(f"s.{c.strip()} IS NOT DISTINCT FROM g.{c.strip()}" for c in IDS_SQL.split(","))}
    WHERE NOT (s.estimate_name = 'count' AND n_count = 1)
    AND NOT (s.estimate_name IN ('mean', 'min', 'max') AND n_mean = 1 AND n_min = 1 AND n_max = 1)""",
)
def format_estimates(spark, d):
    return summarised.format_estimates(
        fx.summarised(spark, d), TEMPLATES, known_names=("count", "mean", "min", "max")
    )


@query(
    "render_template",
    f"""SELECT {ROW_IDS_SQL}, "mean" || ' (' || "min" || ' to ' || "max" || ')' AS shown
    FROM (SELECT {ROW_IDS_SQL}, {_pivot_sql(NAMES, 'estimate_name', 'estimate_value')} FROM {WHITELISTED_SQL} GROUP BY ALL)""",
)
def render_template(spark, d):
    wide = aggregates.pivot_estimates(whitelisted(spark, d), ROW_IDS, NAMES)
    shown = summarised.render_template("<mean> (<min> to <max>)", {n: n for n in NAMES})
    return wide.select(*ROW_IDS, shown.alias("shown"))


SPLIT_STRATA_SQL = """CASE WHEN strata_name = 'overall' THEN 'overall' ELSE string_split(strata_level, ' &&& ')[1] END AS age_group,
    CASE WHEN strata_name = 'overall' THEN 'overall' ELSE string_split(strata_level, ' &&& ')[2] END AS sex"""


@query("split_name_level", f"SELECT *, {SPLIT_STRATA_SQL} FROM fx_summarised")
def split_name_level(spark, d):
    return summarised.split_name_level(
        fx.summarised(spark, d), "strata_name", "strata_level", keep=True, columns=["age_group", "sex"]
    )


@query(
    "split_all",
    f"""SELECT result_id, cdm_name, group_level AS cohort_name, {SPLIT_STRATA_SQL}, variable_name, variable_level,
    estimate_name, estimate_type, estimate_value FROM fx_summarised""",
)
def split_all(spark, d):
    return summarised.split_all(fx.summarised(spark, d), columns=PARTS)


@query(
    "split_known_levels",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MACHINERY and tools' ELSE c_mktsegment END AS segment,
    CASE WHEN c_custkey % 3 = 0 THEN 'overall' ELSE r_name END AS region
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def split_known_levels(spark, d):
    """A level that holds the separator keeps its parts, as it is known from rows of a single name."""
    placed = fx.table(spark, d, "customer").join(fx.places(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
    segment = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("MACHINERY and tools")).otherwise(F.col("c_mktsegment"))
    single = F.col("c_custkey") % 3 == 0
    df = placed.select(
        "c_custkey",
        F.when(single, "segment").otherwise("segment and region").alias("strata_name"),
        F.when(single, segment).otherwise(F.concat(segment, F.lit(" and "), "r_name")).alias("strata_level"),
    )
    return summarised.split_strata(df, columns=["segment", "region"], known={})


_ROUND_SQL = r"regexp_replace(CAST(CAST(round_even(CAST(estimate_value AS DOUBLE), 2) AS DECIMAL(38,2)) AS VARCHAR), '\.?0+$', '')"
_LABEL_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_LABELS.items())
TABLE_ONE_SQL = f"""WITH r AS (
    SELECT * REPLACE ({_ROUND_SQL} AS estimate_value) FROM fx_characterisation
    WHERE estimate_type IN ('integer', 'numeric') AND estimate_name IN ('count', 'percentage', 'mean', 'min', 'max')),
  g AS (SELECT cdm_name, group_level, {SPLIT_STRATA_SQL}, variable_name, variable_level,
    COUNT(*) FILTER (estimate_name = 'count') AS n_count, COUNT(*) FILTER (estimate_name IN ('mean', 'min', 'max')) AS n_range,
    {_pivot_sql(NAMES, "estimate_name", "estimate_value")} FROM r GROUP BY ALL),
  t AS (SELECT *, "count" AS v FROM g WHERE n_count = 1
    UNION ALL SELECT *, "mean" || ' (' || "min" || ' to ' || "max" || ')' FROM g WHERE n_range = 3),
  p AS (SELECT group_level AS o, age_group, sex, CASE WHEN variable_level IS NULL THEN variable_name
      ELSE variable_name || ': ' || variable_level END AS variable, {_pivot_sql(DATABASES, "cdm_name", "v")}
    FROM t GROUP BY ALL),
  j AS (SELECT p.*, a.denominator_sex, a.denominator_age_group, CASE WHEN regexp_matches(o, 'denominator') THEN 'All population'
      ELSE o END AS outcome FROM p LEFT JOIN
      (SELECT DISTINCT denominator_cohort_name, denominator_sex, denominator_age_group FROM fx_rates) a
      ON p.o = a.denominator_cohort_name)
  SELECT CASE outcome {_LABEL_SQL} ELSE outcome END AS "Outcome", age_group, sex AS "sex (stratum)", variable AS "Variable",
    {", ".join(f'"{v}"' for v in DATABASES)}, denominator_sex AS "Sex", denominator_age_group AS "Age group"
  FROM j WHERE NOT (regexp_matches(variable, 'Sex') AND regexp_matches(outcome, 'population'))"""


@query("table_one", TABLE_ONE_SQL)
def table_one(spark, d):
    return table_one_plan.table_one(
        fx.characterisation(spark, d),
        cohorts(spark, d),
        labels=PRIORITY_LABELS,
        databases=DATABASES,
        columns=PARTS,
    )


@query("table_one_view", f"SELECT * FROM ({TABLE_ONE_SQL}) WHERE \"Outcome\" = 'All population'")
def table_one_view(spark, d):
    return table_one_plan.table_one_view(table_one(spark, d))


# ---- displayed tables ---------------------------------------------------------------------

# The stand-in rates lack the settings that never vary; they are stamped on as constants.
_CONSTANTS = {
    "analysis_id": 1,
    "analysis_complete_database_intervals": True,
    "denominator_start_date": "1995-01-01",
    "denominator_end_date": "1998-12-31",
    "cohort_obscured": False,
    "analysis_outcome_washout": "Inf",
    "result_obscured": False,
    "outcome_cohort_id": 1,
    "analysis_repeated_events": False,
    "denominator_cohort_id": 1,
    "analysis_min_cell_count": 5,
    "denominator_target_cohort_definition_id": 1,
    "denominator_days_prior_observation": 365,
}


def full_estimates(spark, d):
    from ..operators.projections import calendar_parts

    df = null_default(tidy_rates(spark, d), "denominator_target_cohort_name", "all_population")
    return stamp(calendar_parts(df, "incidence_start_date"), **_CONSTANTS, time_at_risk="Inf")


VIEW_SELECTION = {
    "database_name": ["ASIA", "EUROPE", "AMERICA"],
    "denominator_age_group": ["0 to 150", "BUILDING", "MACHINERY"],
    "denominator_sex": ["Both", "F", "O"],
}
VIEW_SELECTION_SQL = """database_name IN ('ASIA', 'EUROPE', 'AMERICA')
    AND denominator_age_group IN ('0 to 150', 'BUILDING', 'MACHINERY') AND denominator_sex IN ('Both', 'F', 'O')"""


@query(
    "estimates_view",
    f"""SELECT {STRATUM_SQL}, analysis_interval, incidence_start_date, n_persons, n_events, person_years, incidence_end_date,
    incidence, incidence_95CI_lower, incidence_95CI_upper, CAST(year(incidence_start_date) AS INTEGER) AS year_index,
    CAST(month(incidence_start_date) AS INTEGER) AS month_index, strftime(incidence_start_date, '%Y-%m') AS year_month,
    365 AS denominator_days_prior_observation, 'Inf' AS time_at_risk
    FROM {TIDY_SQL} WHERE {VIEW_SELECTION_SQL}""",
)
def estimates_view(spark, d):
    return incidence.estimates_view(full_estimates(spark, d), VIEW_SELECTION)


def _count_sql(c):
    return f"coalesce(format('{{:,}}', CAST(floor({c}) AS BIGINT)), 'NA')"


def _rate_sql(c):
    return f"coalesce(format('{{:,.2f}}', {c}), 'NA')"


@query(
    "estimates_display",
    f"""SELECT incidence_start_date AS "Start Date", incidence_end_date AS "End Date", {_count_sql("n_persons")} AS "Persons (n)",
    {_count_sql("person_years")} AS "Person Years", {_count_sql("n_events")} AS "Events (n)",
    {_rate_sql("incidence")} || ' (' || {_rate_sql("incidence_95CI_lower")} || ' to ' || {_rate_sql("incidence_95CI_upper")}
      || ')' AS "Incidence (100000 pys)", outcome_cohort_name AS "Outcome", analysis_interval AS "Time Interval",
    denominator_age_group AS "Age", denominator_sex AS "Sex", database_name AS "Database"
    FROM {TIDY_SQL} WHERE {VIEW_SELECTION_SQL}""",
)
def estimates_display(spark, d):
    return incidence.estimates_display(full_estimates(spark, d), VIEW_SELECTION)


@query(
    "attrition_display",
    """SELECT CASE WHEN cdm_name = 'MIDDLE EAST' THEN 'ME' ELSE cdm_name END AS "Database", outcome_cohort_name AS "Outcome",
    reason AS "Reason", number_records AS "Number records", number_subjects AS "Number subjects",
    excluded_records AS "Excluded records", excluded_subjects AS "Excluded subjects", '0 to 150' AS "Age", 'Both' AS "Sex",
    'months' AS "Time Interval" FROM fx_attrition WHERE cdm_name IN ('MIDDLE EAST', 'ASIA')""",
)
def attrition_display(spark, d):
    df = stamp(
        fx.attrition(spark, d),
        **{c: 1 for c in (*incidence.ATTRITION_SETTINGS, *incidence.ATTRITION_HIDDEN) if c != "reason_id"},
        denominator_age_group="0 to 150",
        denominator_sex="Both",
        analysis_interval="months",
    )
    selection = {"cdm_name": ["ME", "ASIA"], "denominator_sex": ["Both"], "analysis_interval": ["months"]}
    return incidence.attrition_display(df, selection, aliases={"MIDDLE EAST": "ME"})


@query(
    "attrition_flow",
    """SELECT cdm_name, outcome_cohort_name AS cohort_name, CAST(reason_id AS DOUBLE) AS reason_id, reason,
    CAST(number_records AS VARCHAR) AS number_records, CAST(number_subjects AS VARCHAR) AS number_subjects,
    CAST(excluded_records AS VARCHAR) AS excluded_records, CAST(excluded_subjects AS VARCHAR) AS excluded_subjects,
    CAST(ROW_NUMBER() OVER w AS INTEGER) AS step, CAST(LEAD(excluded_records) OVER w AS VARCHAR) AS lost_records,
    CAST(LEAD(excluded_subjects) OVER w AS VARCHAR) AS lost_subjects, LEAD(reason) OVER w AS next_reason
    FROM fx_attrition WINDOW w AS (PARTITION BY cdm_name, outcome_cohort_name ORDER BY reason_id)""",
)
def attrition_flow(spark, d):
    return incidence.attrition_flow(fx.attrition_long(spark, d))


@query(
    "snapshot_view",
    """SELECT CASE WHEN r_name = 'MIDDLE EAST' THEN 'ME' ELSE r_name END AS cdm_name, CAST(COUNT(DISTINCT n_name) AS VARCHAR)
    AS cdm_version, COUNT(*) AS person_count FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def snapshot_view(spark, d):
    customers = fx.table(spark, d, "customer").join(
        fx.places(spark, d), F.col("c_nationkey") == F.col("n_nationkey")
    )
    snapshot = customers.groupBy(F.col("r_name").alias("cdm_name")).agg(
        F.count_distinct("n_name").alias("cdm_version"),
        F.count(F.lit(1)).alias("person_count"),
        F.max("n_name").alias("cdm_source_name"),
        F.min("n_name").alias("cdm_description"),
    )
    return incidence.snapshot_view(snapshot, {"MIDDLE EAST": "ME"})


@query(
    "plot_series",
    f"""SELECT incidence_start_date AS x, incidence AS y, incidence_95CI_lower AS ymin, incidence_95CI_upper AS ymax,
    outcome_cohort_name || '; ' || denominator_sex AS "Group", database_name AS facet_var
    FROM {TIDY_SQL} WHERE {VIEW_SELECTION_SQL}""",
)
def plot_series(spark, d):
    view = incidence.estimates_view(full_estimates(spark, d), VIEW_SELECTION)
    return incidence.plot_series(
        view, "incidence_start_date", ["outcome_cohort_name", "denominator_sex"], ["database_name"]
    )


@query(
    "index_overlay",
    f"""WITH j AS (SELECT f.*, coalesce(m.si, 0) AS si FROM (SELECT *, {COUNTRY_SQL} AS country FROM {TIDY_SQL}) f
      LEFT JOIN {MONTHLY_SQL} m ON f.country = m.country AND f.incidence_start_date = m.date WHERE incidence IS NOT NULL),
    s AS (SELECT *, CASE WHEN MAX(si) OVER w <> 0 THEN si / (MAX(si) OVER w / MAX(incidence) OVER w) END AS scaled FROM j
      WINDOW w AS (PARTITION BY database_name))
    SELECT * FROM (SELECT {STRATUM_SQL}, incidence_start_date, country, round(scaled, 6) AS si,
      {", ".join(map(_rolling_sql, RATE_COLUMNS))} FROM s) WHERE incidence IS NOT NULL""",
)
def index_overlay(spark, d):
    out = covariates.index_overlay(
        tidy_rates(spark, d, persons=False), fx.index(spark, d), country_dim(spark), smooth=True
    )
    return out.select(
        *STRATUM,
        "incidence_start_date",
        "country",
        *[F.round(c, 6).alias(c) for c in ["si", *RATE_COLUMNS]],
    )
