"""Registered queries: sources, projections, filters, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, projections, sets
from ..plans import lake
from ..sources import dims, files, schemas
from ..sources.scratch import shared_folder
from . import fixtures as fx
from .registry import query

STRATUM_SQL = "database_name, outcome_cohort_name, denominator_age_group, denominator_sex"

# ---- sources ------------------------------------------------------------------------------

URL_CLASSES = {
    "secure": {"all": ["^https"]},
    "blog_with_query": {"all": ["blog", r"\?"]},
    "english_untracked": {"all": ["/en/"], "none": ["utm"]},
    "html": {"all": [r"\.html"]},
}


@query(
    "classify_files",
    r"""SELECT url AS path, regexp_matches(url, '^https') AS secure,
       regexp_matches(url, 'blog') AND regexp_matches(url, '\?') AS blog_with_query,
       regexp_matches(url, '/en/') AND NOT regexp_matches(url, 'utm') AS english_untracked,
       regexp_matches(url, '\.html') AS html FROM pages""",
)
def classify_files(spark, d):
    paths = fx.table(spark, d, "pages").select(F.col("url").alias("path"))
    return files.classify_paths(paths, "path", URL_CLASSES)


@query(
    "path_tag",
    """SELECT page_id, url, CASE WHEN regexp_matches(url, '/en/') THEN 'en'
       WHEN regexp_matches(url, '/(fr|de)/') THEN 'fr or de' ELSE 'other' END AS tag FROM pages""",
)
def path_tag(spark, d):
    pages = fx.table(spark, d, "pages").select("page_id", "url")
    return projections.path_tag(pages, "url", [("/en/", "en"), ("/(fr|de)/", "fr or de")], "other", "tag")


@query("csv_roundtrip", """SELECT *, ' ' || outcome_cohort_name || chr(10) || '"x", ' AS note FROM fx_rates""")
def csv_roundtrip(spark, d):
    """Edge blanks, quotes and line breaks included. Writes when called."""
    note = F.concat(F.lit(" "), "outcome_cohort_name", F.lit('\n"x", '))
    df = fx.rates(spark, d).withColumn("note", note)
    path = shared_folder(spark, "export")
    files.write_export(df, path, ["database_name"])
    return files.read_export(spark, path, df.schema, multi_line=True)


@query(
    "load_results",
    f"""SELECT {STRATUM_SQL}, analysis_interval, CASE WHEN database_name IN ('ASIA', 'AFRICA') THEN 1 END AS analysis_id,
    incidence_start_date, incidence_end_date, CAST(n_persons AS DOUBLE) AS n_persons, n_events, person_years,
    incidence_100000_pys AS incidence, incidence_100000_pys_95CI_lower AS incidence_95CI_lower,
    incidence_100000_pys_95CI_upper AS incidence_95CI_upper, denominator_cohort_name,
    coalesce(denominator_target_cohort_name, 'all_population') AS denominator_target_cohort_name,
    CASE WHEN database_name IN ('ASIA', 'AFRICA') THEN '30' ELSE '365' END AS time_at_risk,
    CAST(year(incidence_start_date) AS INTEGER) AS year_index, CAST(month(incidence_start_date) AS INTEGER) AS month_index,
    strftime(incidence_start_date, '%Y-%m') AS year_month FROM fx_rates""",
)
def load_results(spark, d):
    """Result files of two layouts, written out and loaded back through the whole ETL. Writes when called."""
    root = f"{shared_folder(spark, 'results')}/My DB [v1] 50%"
    df = fx.rates(spark, d).withColumnRenamed("database_name", "cdm_name")
    first = F.col("cdm_name").isin("ASIA", "AFRICA")
    one = df.filter(first).withColumn("analysis_id", F.lit(1))
    files.write_export(one, f"{root}/a/Incidence_tar30.csv")
    files.write_export(df.filter(~first).select(*reversed(df.columns)), f"{root}/b/Incidence_tar365.csv")
    loaded = lake.load_results(spark, root)["incidence_estimates"]
    absent = set(schemas.INCIDENCE_ESTIMATES.fieldNames()) - set(one.columns)
    return loaded.drop(*absent)


@query("covariate_series", "SELECT country, date, si FROM fx_index")
def covariate_series(spark, d):
    path = shared_folder(spark, "index")
    fx.index(spark, d).select(
        F.col("country").alias("Entity"),
        F.col("date").alias("Day"),
        F.col("si").alias("Stringency index (weighted average)"),
    ).write.option("header", True).option("nullValue", "NA").csv(path)
    return files.covariate_series(
        spark,
        path,
        {"Entity": "country", "Day": "date", "Stringency.index..weighted.average.": "si"},
        date_col="date",
        number_cols=["si"],
    )


REGION_COUNTRY = {r: r for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE")}
PRIORITY_LABELS = {
    "1-URGENT": "Urgent",
    "2-HIGH": "High",
    "3-MEDIUM": "Medium",
    "4-NOT SPECIFIED": "Not specified",
}
REGION_VALUES_SQL = "(VALUES ('AFRICA','AFRICA'),('AMERICA','AMERICA'),('ASIA','ASIA'),('EUROPE','EUROPE')) c(database, country)"
LABEL_VALUES_SQL = "(VALUES ('1-URGENT','Urgent'),('2-HIGH','High'),('3-MEDIUM','Medium'),('4-NOT SPECIFIED','Not specified')) l(code, label)"


@query(
    "literal_dims",
    f"""SELECT country, label, t.name AS timepoint_name, COUNT(*) AS n
    FROM fx_incidence f LEFT JOIN {REGION_VALUES_SQL} ON f.database_name = c.database
    LEFT JOIN {LABEL_VALUES_SQL} ON f.outcome_cohort_name = l.code
    LEFT JOIN (VALUES ('first', DATE '1998-03-01'), ('second', DATE '1998-04-01')) t(name, day)
      ON f.incidence_start_date = t.day
    GROUP BY country, label, t.name""",
)
def literal_dims(spark, d):
    import datetime as dt

    countries = dims.mapping_table(spark, REGION_COUNTRY, "database", "country")
    labels = dims.mapping_table(spark, PRIORITY_LABELS, "code", "label")
    times = dims.mapping_table(
        spark,
        {"first": dt.date(1998, 3, 1), "second": dt.date(1998, 4, 1)},
        "timepoint_name",
        "day",
    )
    df = fx.incidence(spark, d)
    return (
        df.join(countries, df.database_name == countries.database, "left")
        .join(labels, df.outcome_cohort_name == labels.code, "left")
        .join(times, df.incidence_start_date == times.day, "left")
        .groupBy("country", "label", "timepoint_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---- projections --------------------------------------------------------------------------


@query(
    "drop_constant_settings",
    "SELECT * EXCLUDE (analysis_interval, n_persons, denominator_target_cohort_name) FROM fx_rates",
)
def drop_constant_settings(spark, d):
    return projections.drop_constant_settings(
        fx.rates(spark, d), ["analysis_interval", "n_persons", "denominator_target_cohort_name"]
    )


@query(
    "rename_display",
    """SELECT database_name AS "Database", outcome_cohort_name AS "Outcome", denominator_age_group AS "Age",
    denominator_sex AS "Sex", analysis_interval AS "Time Interval", incidence_start_date AS "Start Date",
    n_persons AS "Persons (n)", n_events AS "Events (n)", person_years AS "Person Years" FROM fx_incidence""",
)
def rename_display(spark, d):
    from ..plans.incidence import ESTIMATE_NAMES

    df = fx.incidence(spark, d)
    return projections.rename_display(df, {k: v for k, v in ESTIMATE_NAMES.items() if k in df.columns})


@query(
    "relocate_columns",
    """SELECT reason, number_subjects, number_records, cdm_name, outcome_cohort_name, reason_id,
    excluded_records, excluded_subjects FROM fx_attrition""",
)
def relocate_columns(spark, d):
    df = projections.relocate_columns(fx.attrition(spark, d), ["reason"], before="cdm_name")
    return projections.relocate_columns(df, ["number_subjects", "number_records"], after="reason")


@query(
    "calendar_parts",
    f"""SELECT {STRATUM_SQL}, incidence_start_date, CAST(year(incidence_start_date) AS INTEGER) AS year_index,
    CAST(month(incidence_start_date) AS INTEGER) AS month_index,
    strftime(incidence_start_date, '%Y-%m') AS year_month FROM fx_incidence""",
)
def calendar_parts(spark, d):
    df = fx.incidence(spark, d, persons=False).drop("analysis_interval", "n_events", "person_years")
    return projections.calendar_parts(df, "incidence_start_date")


@query(
    "alias_recode",
    """SELECT * REPLACE (CASE WHEN database_name = 'MIDDLE EAST' THEN 'ME' ELSE database_name END AS database_name)
    FROM fx_incidence""",
)
def alias_recode(spark, d):
    return projections.alias_recode(fx.incidence(spark, d), "database_name", {"MIDDLE EAST": "ME"})


@query(
    "null_default",
    """SELECT * REPLACE (coalesce(denominator_target_cohort_name, 'all_population') AS denominator_target_cohort_name)
    FROM fx_rates""",
)
def null_default(spark, d):
    return projections.null_default(fx.rates(spark, d), "denominator_target_cohort_name", "all_population")


@query(
    "label_recode",
    f"""SELECT f.* REPLACE (coalesce(l.label, f.outcome_cohort_name) AS outcome_cohort_name),
    f.outcome_cohort_name AS sort_key
    FROM fx_incidence f LEFT JOIN {LABEL_VALUES_SQL} ON f.outcome_cohort_name = l.code""",
)
def label_recode(spark, d):
    return projections.label_recode(
        fx.incidence(spark, d), "outcome_cohort_name", PRIORITY_LABELS, "sort_key"
    )


@query(
    "regex_recode",
    """SELECT * REPLACE (CASE WHEN regexp_matches(denominator_cohort_name, 'denominator [FB]') THEN 'All population'
    ELSE denominator_cohort_name END AS denominator_cohort_name) FROM fx_rates""",
)
def regex_recode(spark, d):
    return projections.regex_recode(
        fx.rates(spark, d), "denominator_cohort_name", "denominator [FB]", "All population"
    )


@query(
    "unite_key",
    """SELECT *, concat_ws('; ', database_name, coalesce(denominator_target_cohort_name, 'NA'),
    coalesce(CAST(n_persons AS VARCHAR), 'NA')) AS "Group" FROM fx_rates""",
)
def unite_key(spark, d):
    return projections.unite_key(
        fx.rates(spark, d), "Group", ["database_name", "denominator_target_cohort_name", "n_persons"]
    )


@query(
    "variable_label",
    """SELECT * REPLACE (CASE WHEN variable_level IS NOT NULL THEN variable_name || ': ' || variable_level
    ELSE variable_name END AS variable_name) FROM fx_summarised""",
)
def variable_label(spark, d):
    return projections.variable_label(fx.summarised(spark, d), "variable_name", "variable_level")


# ---- filters ------------------------------------------------------------------------------

SELECTION = {
    "database_name": ["ASIA", "EUROPE", "NOWHERE"],
    "incidence_start_date": [f"1997-{m:02d}-01" for m in range(1, 13)],
    "denominator_age_group": ["0 to 150", "BUILDING"],
    "denominator_sex": ["Both", "F"],
    "outcome_cohort_name": ["1-URGENT", "2-HIGH", "5-LOW"],
    "analysis_interval": ["months", "years"],
}
SELECTION_SQL = """database_name IN ('ASIA', 'EUROPE', 'NOWHERE') AND year(incidence_start_date) = 1997
    AND denominator_age_group IN ('0 to 150', 'BUILDING') AND denominator_sex IN ('Both', 'F')
    AND outcome_cohort_name IN ('1-URGENT', '2-HIGH', '5-LOW') AND analysis_interval IN ('months', 'years')"""


@query("multi_filter", f"SELECT * FROM fx_incidence WHERE {SELECTION_SQL}")
def multi_filter(spark, d):
    return filters.multi_filter(fx.incidence(spark, d), SELECTION)


@query(
    "attrition_filter",
    """SELECT * FROM fx_attrition WHERE cdm_name IN ('ASIA', 'AMERICA') AND outcome_cohort_name IN ('1-URGENT', '5-LOW')
    AND reason_id IN (1, 2, 4)""",
)
def attrition_filter(spark, d):
    return filters.attrition_filter(
        fx.attrition(spark, d),
        {"cdm_name": ["ASIA", "AMERICA"], "outcome_cohort_name": ["1-URGENT", "5-LOW"], "reason_id": [1, 2, 4]},
    )


@query(
    "monthly_subset",
    """SELECT * FROM fx_incidence WHERE analysis_interval = 'months' AND database_name IN ('AFRICA')
    AND denominator_sex IN ('O', 'P')""",
)
def monthly_subset(spark, d):
    return filters.monthly_subset(
        fx.with_intervals(fx.incidence(spark, d)), {"database_name": ["AFRICA"], "denominator_sex": ["O", "P"]}
    )


@query("equality_filter", "SELECT * FROM fx_incidence WHERE database_name = 'AMERICA'")
def equality_filter(spark, d):
    return filters.equality_filter(fx.incidence(spark, d), "database_name", "AMERICA")


TYPES, ESTIMATES = ("integer", "numeric"), ("count", "percentage", "mean", "min")


@query(
    "estimate_whitelist",
    """SELECT * FROM fx_summarised WHERE estimate_type IN ('integer', 'numeric')
    AND estimate_name IN ('count', 'percentage', 'mean', 'min')""",
)
def estimate_whitelist(spark, d):
    return filters.estimate_whitelist(fx.summarised(spark, d), TYPES, ESTIMATES)


@query("country_whitelist", "SELECT * FROM fx_index WHERE country IN ('ASIA', 'AFRICA', 'ATLANTIS')")
def country_whitelist(spark, d):
    return filters.country_whitelist(fx.index(spark, d), "country", ["ASIA", "AFRICA", "ATLANTIS"])


@query(
    "quality_cutoff",
    """SELECT * FROM fx_incidence WHERE NOT (regexp_matches(database_name, 'AMER')
    AND incidence_start_date > DATE '1998-01-01')""",
)
def quality_cutoff(spark, d):
    return filters.quality_cutoff(
        fx.incidence(spark, d), "database_name", "AMER", "incidence_start_date", "1998-01-01"
    )


@query(
    "double_regex_drop",
    """SELECT * FROM fx_summarised WHERE NOT (coalesce(regexp_matches(variable_name, 'Sex'), false)
    AND coalesce(regexp_matches(group_level, '^[12]'), false))""",
)
def double_regex_drop(spark, d):
    return filters.double_regex_drop(fx.summarised(spark, d), "variable_name", "Sex", "group_level", "^[12]")


@query(
    "complete_rows",
    "SELECT * FROM fx_rates WHERE incidence_100000_pys IS NOT NULL AND denominator_target_cohort_name IS NOT NULL",
)
def complete_rows(spark, d):
    return filters.complete_rows(
        fx.rates(spark, d), ["incidence_100000_pys", "denominator_target_cohort_name"]
    )


@query("outcome_gate", "SELECT * FROM fx_incidence WHERE NOT regexp_matches(outcome_cohort_name, 'URGENT|NOT')")
def outcome_gate(spark, d):
    return filters.outcome_gate(fx.incidence(spark, d), "outcome_cohort_name", "URGENT|NOT")


@query("pre_period", "SELECT * FROM fx_incidence WHERE incidence_start_date <= DATE '1998-04-01'")
def pre_period(spark, d):
    return filters.pre_period(fx.incidence(spark, d), "incidence_start_date", "1998-04-01")


@query("drop_timepoint_row", "SELECT * FROM fx_incidence WHERE incidence_start_date <> DATE '1998-04-01'")
def drop_timepoint_row(spark, d):
    return filters.drop_timepoint_row(fx.incidence(spark, d), "incidence_start_date", "1998-04-01")


# ---- unions and order ---------------------------------------------------------------------


@query(
    "ragged_union",
    """SELECT * REPLACE (CASE WHEN database_name IN ('ASIA', 'AFRICA') THEN NULL ELSE n_persons END AS n_persons,
    CASE WHEN database_name IN ('ASIA', 'AFRICA') THEN analysis_interval END AS analysis_interval)
    FROM fx_incidence""",
)
def ragged_union(spark, d):
    df = fx.incidence(spark, d)
    first = F.col("database_name").isin("ASIA", "AFRICA")
    return sets.ragged_union([df.filter(first).drop("n_persons"), df.filter(~first).drop("analysis_interval")])


@query(
    "bag_union",
    "SELECT * FROM fx_attrition UNION ALL SELECT * FROM fx_attrition WHERE excluded_records > 0",
)
def bag_union(spark, d):
    df = fx.attrition(spark, d)
    return sets.bag_union(df, df.filter(F.col("excluded_records") > 0))


@query(
    "template_order",
    """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 1 WHEN '2-HIGH' THEN 2
    ELSE 3 END AS format_id, MIN(o_orderkey) OVER (PARTITION BY o_orderpriority) AS name_first_id FROM orders""",
)
def template_order(spark, d):
    df = fx.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sets.template_order(df, ["4-NOT SPECIFIED", "2-HIGH"], "o_orderkey", "o_orderpriority")


# ---- scalar functions ---------------------------------------------------------------------


@query(
    "regex_flags",
    r"""SELECT page_id, url, regexp_matches(url, '^http:') AS plain, NOT regexp_matches(url, 'utm_') AS not_tracked
    FROM pages""",
)
def regex_flags(spark, d):
    pages = fx.table(spark, d, "pages").select("page_id", "url")
    return projections.regex_flags(pages, "url", {"plain": "^http:", "not_tracked": ("utm_", True)})


@query(
    "regex_clean",
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', '', 'g'), '^https?://(www\.)?', '', 'g') AS address
    FROM pages""",
)
def regex_clean(spark, d):
    pages = fx.table(spark, d, "pages").select("page_id", "url")
    rules = [(r"[?#].*$", ""), (r"^https?://(www\.)?", "")]
    return projections.regex_clean(pages, "url", rules, "address").drop("url")


@query(
    "template_keys",
    """SELECT page_id, len(k) AS n_keys, array_to_string(k, '|') AS keys
    FROM (SELECT page_id, regexp_extract_all(html, '<(.+?)>', 1) AS k FROM pages)""",
)
def template_keys(spark, d):
    pages = projections.template_keys(fx.table(spark, d, "pages"), "html", "k")
    return pages.select(
        "page_id",
        F.size("k").cast("long").alias("n_keys"),
        F.array_join("k", "|").alias("keys"),
    )


@query(
    "split_levels",
    """SELECT doc_id, len(l) AS n_levels, len(list_distinct(l)) AS n_distinct
    FROM (SELECT doc_id, string_split_regex(text, ' and | &&& ') AS l FROM documents)""",
)
def split_levels(spark, d):
    docs = projections.split_levels(fx.table(spark, d, "documents").select("doc_id", "text"), "text")
    return docs.select(
        "doc_id",
        F.col("n_levels").cast("long").alias("n_levels"),
        F.size(F.array_distinct("levels")).cast("long").alias("n_distinct"),
    )


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
    CAST(month(o_orderdate) AS INTEGER) AS month, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders""",
)
def date_parts(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return projections.date_parts(orders, "o_orderdate").drop("o_orderdate")


@query(
    "safe_cast",
    """SELECT *, TRY_CAST(estimate_value AS DOUBLE) AS number, TRY_CAST(group_level AS INTEGER) AS not_a_number
    FROM fx_summarised""",
)
def safe_cast(spark, d):
    df = projections.safe_cast(fx.summarised(spark, d), "estimate_value", "double", "number")
    return projections.safe_cast(df, "group_level", "int", "not_a_number")


@query(
    "number_format",
    """SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS d0, format('{:,.1f}', o_totalprice) AS d1,
    format('{:,.2f}', o_totalprice) AS d2, format('{:,.3f}', o_totalprice) AS d3 FROM orders""",
)
def number_format(spark, d):
    df = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    for decimals in (0, 1, 2, 3):
        df = projections.number_format(df, "o_totalprice", decimals, f"d{decimals}")
    return df.drop("o_totalprice")


@query(
    "rate_per_100k",
    f"""SELECT {STRATUM_SQL}, incidence_start_date, round_even(n_events * 100000 / person_years, 3) AS rate
    FROM fx_incidence""",
)
def rate_per_100k(spark, d):
    df = projections.rate_per_100k(
        fx.incidence(spark, d, persons=False), "n_events", "person_years", "rate", 3
    )
    return df.drop("analysis_interval", "n_events", "person_years")


@query(
    "deviance_residuals",
    """SELECT *, round(CASE WHEN y > mu THEN 1.0 WHEN y < mu THEN -1.0 ELSE 0.0 END
    * sqrt(greatest(2 * (y * ln(y / mu) - (y - mu)), 0)), 6) + 0.0 AS residual
    FROM (SELECT database_name, outcome_cohort_name, denominator_age_group, denominator_sex, timepoint, time,
      n_events_sum AS y, round(person_years_sum * (SUM(n_events_sum) OVER w / SUM(person_years_sum) OVER w), 6) AS mu
      FROM fx_sr_quarterly
      WINDOW w AS (PARTITION BY database_name, outcome_cohort_name, denominator_age_group, denominator_sex, timepoint))""",
)
def deviance_residuals(spark, d):
    # Expected counts under a constant rate: the intercept-only fit has this closed form.
    from pyspark.sql import Window as W

    from ..plans.series import SERIES, sr_series_quarterly

    series = sr_series_quarterly(fx.incidence(spark, d, persons=False), timepoints=fx.TIMEPOINTS)
    whole = W.partitionBy(*SERIES)
    share = F.sum("n_events_sum").over(whole) / F.sum("person_years_sum").over(whole)
    expected = series.select(
        *SERIES,
        "time",
        F.col("n_events_sum").alias("y"),
        F.round(F.col("person_years_sum") * share, 6).alias("mu"),
    )
    out = projections.deviance_residuals(expected, "y", "mu")
    return out.withColumn("residual", F.round("residual", 6) + F.lit(0.0))
