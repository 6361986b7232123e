"""SQL of the stand-in views, in dependency order. Independent of the DataFrame versions."""

from .fit_sql import coefficient_sql, fit_sql

STRATUM = "database_name, outcome_cohort_name, denominator_age_group, denominator_sex"

VIEWS: dict[str, str] = {}

VIEWS["fx_incidence"] = """
SELECT database_name, outcome_cohort_name, denominator_age_group, denominator_sex, analysis_interval,
       incidence_start_date, n_persons,
       CASE WHEN raw_events BETWEEN 1 AND 2 THEN NULL ELSE CAST(raw_events AS DOUBLE) END AS n_events,
       CASE WHEN database_name = 'ASIA' AND incidence_start_date = DATE '1998-08-01' THEN NULL ELSE pt END AS person_years
FROM (
  SELECT r.r_name AS database_name, o.o_orderpriority AS outcome_cohort_name,
         coalesce(c.c_mktsegment, '0 to 150') AS denominator_age_group,
         coalesce(o.o_orderstatus, 'Both') AS denominator_sex,
         'months' AS analysis_interval,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) AS incidence_start_date,
         COUNT(DISTINCT o.o_custkey) AS n_persons,
         SUM(CASE WHEN r.r_name = 'AMERICA' AND o.o_orderdate < DATE '1996-01-01' THEN 0
                  WHEN r.r_name = 'EUROPE' AND o.o_orderpriority = '5-LOW' THEN 0 ELSE 1 END) AS raw_events,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS pt
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY r.r_name, o.o_orderpriority, CAST(date_trunc('month', o.o_orderdate) AS DATE),
           CUBE(c.c_mktsegment, o.o_orderstatus)) g
"""

VIEWS["fx_rates"] = """
SELECT f.*, last_day(incidence_start_date) AS incidence_end_date,
       round(n_events * 100000 / person_years, 4) AS incidence_100000_pys,
       CASE WHEN n_events IS NOT NULL THEN
            round(greatest(n_events - 1.96 * sqrt(n_events), 0) * 100000 / person_years, 4) END AS incidence_100000_pys_95CI_lower,
       round((n_events + 1.96 * sqrt(n_events)) * 100000 / person_years, 4) AS incidence_100000_pys_95CI_upper,
       concat(outcome_cohort_name, ' denominator ', denominator_sex) AS denominator_cohort_name,
       CASE WHEN denominator_sex = 'Both' THEN NULL ELSE 'target' END AS denominator_target_cohort_name
FROM fx_incidence f
"""

VIEWS["fx_index"] = """
SELECT r.r_name AS country, CAST(l.l_shipdate AS DATE) AS date,
       CASE WHEN r.r_name = 'ASIA' AND CAST(l.l_shipdate AS DATE) = DATE '1998-02-01' THEN NULL
            ELSE round(CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 4) END AS si
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, CAST(l.l_shipdate AS DATE)
"""

VIEWS["fx_summarised"] = """
WITH b AS (
  SELECT r.r_name AS cdm_name, o.o_orderpriority AS cohort, c.c_mktsegment AS seg, o.o_orderstatus AS st,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS v
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
a AS (
  SELECT cdm_name, cohort, 'overall' AS strata_name, 'overall' AS strata_level,
         COUNT(*) AS n, CAST(SUM(v) AS DOUBLE)/COUNT(*) AS mn, MIN(v) AS lo, MAX(v) AS hi
  FROM b GROUP BY cdm_name, cohort
  UNION ALL
  SELECT cdm_name, cohort, 'age_group &&& sex', concat(seg, ' &&& ', st),
         COUNT(*), CAST(SUM(v) AS DOUBLE)/COUNT(*), MIN(v), MAX(v)
  FROM b GROUP BY cdm_name, cohort, seg, st),
s AS (SELECT cdm_name, cohort, st, COUNT(*) AS n FROM b GROUP BY cdm_name, cohort, st),
l AS (
  SELECT cdm_name, cohort, strata_name, strata_level, 'Number records' AS variable_name, CAST(NULL AS VARCHAR) AS variable_level,
         'count' AS estimate_name, 'integer' AS estimate_type, CAST(n AS VARCHAR) AS estimate_value FROM a
  UNION ALL SELECT cdm_name, cohort, strata_name, strata_level, 'Order value', NULL, 'mean', 'numeric',
         CAST(CAST(floor(mn) AS BIGINT) AS VARCHAR) FROM a
  UNION ALL SELECT cdm_name, cohort, strata_name, strata_level, 'Order value', NULL, 'min', 'numeric',
         CASE WHEN cdm_name = 'ASIA' AND strata_name = 'overall' THEN NULL ELSE CAST(lo AS VARCHAR) END FROM a
  UNION ALL SELECT cdm_name, cohort, strata_name, strata_level, 'Order value', NULL, 'max', 'numeric',
         CAST(hi AS VARCHAR) FROM a WHERE NOT (cdm_name = 'EUROPE' AND strata_name = 'overall')
  UNION ALL SELECT cdm_name, cohort, 'overall', 'overall', 'Sex', st, 'count', 'integer', CAST(n AS VARCHAR) FROM s
  UNION ALL SELECT cdm_name, cohort, 'overall', 'overall', 'First date', NULL, 'min', 'date', '1995-01-01' FROM s)
SELECT 1 AS result_id, cdm_name, 'cohort_name' AS group_name, cohort AS group_level, strata_name, strata_level,
       variable_name, variable_level, estimate_name, estimate_type, estimate_value,
       'overall' AS additional_name, 'overall' AS additional_level
FROM l
"""

VIEWS["fx_characterisation"] = """
SELECT * REPLACE (CASE WHEN group_level IN ('1-URGENT', '5-LOW') THEN group_level
                       ELSE group_level || ' denominator Both' END AS group_level)
FROM fx_summarised
"""

VIEWS["fx_attrition"] = """
WITH b AS (
  SELECT r.r_name AS cdm_name, o.o_orderpriority AS cohort, o.o_custkey AS subj,
         CASE WHEN o.o_orderstatus = 'P' THEN 1 WHEN o.o_totalprice < 100000 THEN 2
              WHEN o.o_orderdate < DATE '1996-01-01' THEN 3 ELSE 4 END AS lost_at
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
k AS (SELECT 1 AS reason_id, 'Initial events' AS reason UNION ALL SELECT 2, 'Not partial'
      UNION ALL SELECT 3, 'Value at least 100000' UNION ALL SELECT 4, 'In study period'),
c AS (SELECT b.cdm_name, b.cohort, k.reason_id, k.reason, COUNT(*) AS number_records, COUNT(DISTINCT b.subj) AS number_subjects
      FROM b JOIN k ON b.lost_at >= k.reason_id GROUP BY b.cdm_name, b.cohort, k.reason_id, k.reason)
SELECT cdm_name, cohort AS outcome_cohort_name, reason_id, reason, number_records, number_subjects,
       COALESCE((LAG(number_records) OVER w) - number_records, 0) AS excluded_records,
       COALESCE((LAG(number_subjects) OVER w) - number_subjects, 0) AS excluded_subjects
FROM c WINDOW w AS (PARTITION BY cdm_name, cohort ORDER BY reason_id)
"""

VIEWS["fx_quarterly"] = f"""
SELECT {STRATUM}, CAST(year(incidence_start_date) AS INTEGER) AS year,
       CAST(quarter(incidence_start_date) AS INTEGER) AS quarter,
       SUM(coalesce(n_events, 1)) AS n_events_sum,
       CASE WHEN COUNT(person_years) = COUNT(*)
            THEN CAST(SUM(CAST(person_years AS DECIMAL(28,5))) AS DOUBLE) END AS person_years_sum,
       make_date(year(incidence_start_date), quarter(incidence_start_date) * 3 - 2, 1) AS incidence_start_date
FROM fx_incidence WHERE analysis_interval = 'months'
GROUP BY {STRATUM}, year(fx_incidence.incidence_start_date), quarter(fx_incidence.incidence_start_date)
"""

VIEWS["fx_monthly"] = f"""
SELECT {STRATUM}, CAST(year(incidence_start_date) AS INTEGER) AS year,
       CAST(quarter(incidence_start_date) AS INTEGER) AS quarter,
       CAST(month(incidence_start_date) AS INTEGER) AS month,
       SUM(coalesce(n_events, 1)) AS n_events_sum,
       CASE WHEN COUNT(person_years) = COUNT(*)
            THEN CAST(SUM(CAST(person_years AS DECIMAL(28,5))) AS DOUBLE) END AS person_years_sum,
       make_date(year(incidence_start_date), month(incidence_start_date), 1) AS incidence_start_date
FROM fx_incidence WHERE analysis_interval = 'months'
GROUP BY {STRATUM}, year(fx_incidence.incidence_start_date), quarter(fx_incidence.incidence_start_date),
         month(fx_incidence.incidence_start_date)
"""


def _model_input(rolled: str) -> str:
    return f"""
WITH d AS (
  SELECT r.*, p.timepoint FROM {rolled} r,
         (SELECT DATE '1998-03-01' AS timepoint UNION ALL SELECT DATE '1998-04-01') p
  WHERE r.incidence_start_date <> p.timepoint),
f AS (
  SELECT *, MIN(CASE WHEN n_events_sum <> 0 THEN incidence_start_date END)
            OVER (PARTITION BY {STRATUM}, timepoint) AS first_nonzero FROM d)
SELECT * EXCLUDE (first_nonzero) REPLACE (CASE WHEN n_events_sum = 0 THEN 5.0 ELSE n_events_sum END AS n_events_sum),
       CAST(CASE WHEN incidence_start_date >= timepoint THEN 1 ELSE 0 END AS INTEGER) AS intrv,
       CAST(ROW_NUMBER() OVER (PARTITION BY {STRATUM}, timepoint ORDER BY incidence_start_date) AS INTEGER) AS time
FROM f WHERE incidence_start_date >= first_nonzero AND person_years_sum IS NOT NULL
"""


VIEWS["fx_sr_quarterly"] = _model_input("fx_quarterly")
VIEWS["fx_sr_monthly"] = _model_input("fx_monthly")
VIEWS["fx_fit"] = fit_sql("fx_sr_quarterly", lagged=False)
VIEWS["fx_fit_lagged"] = fit_sql("fx_sr_quarterly", lagged=True)
VIEWS["fx_fit_monthly"] = fit_sql("fx_sr_monthly", lagged=True)
# Order value in cents as events, orders as person-time: counts of 1e6 and more.
VIEWS["fx_sr_large"] = """
SELECT * REPLACE (round(person_years_sum * 100000) AS n_events_sum, CAST(n_events_sum AS DOUBLE) AS person_years_sum)
FROM fx_sr_quarterly
"""
VIEWS["fx_fit_large"] = fit_sql("fx_sr_large", lagged=False)
VIEWS["fx_coefficients"] = coefficient_sql("fx_fit")
VIEWS["fx_fit_pooled"] = fit_sql("fx_sr_quarterly", lagged=True, together="model")
VIEWS["fx_pooled"] = coefficient_sql("fx_fit_pooled", keys="status, n_obs, rank, dispersion")
