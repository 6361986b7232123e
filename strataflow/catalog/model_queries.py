"""Registered queries: series, regression, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import correlation, pooled, regression, series
from ..plans.series import SERIES, STRATUM
from ..sources.bucketed import read_bucketed
from ..sources.scratch import shared_folder
from . import fixtures as fx
from .registry import query
from .shape_queries import TIDY_SQL, tidy_rates

STRATUM_SQL = ", ".join(STRATUM)
SERIES_SQL = ", ".join(SERIES)


def quarterly(spark, d):
    rows = fx.with_intervals(fx.incidence(spark, d, persons=False))
    return series.sr_series_quarterly(rows, timepoints=fx.TIMEPOINTS)


def monthly(spark, d):
    rows = fx.with_intervals(fx.incidence(spark, d, persons=False))
    return series.sr_series_monthly(rows, timepoints=fx.TIMEPOINTS)


@query("sr_series_quarterly", "SELECT * FROM fx_sr_quarterly")
def sr_series_quarterly(spark, d):
    return quarterly(spark, d).withColumn("person_years_sum", F.round("person_years_sum", 5))


@query("sr_series_monthly", "SELECT * FROM fx_sr_monthly")
def sr_series_monthly(spark, d):
    return monthly(spark, d).withColumn("person_years_sum", F.round("person_years_sum", 5))


@query("stored_series", "SELECT * FROM fx_sr_quarterly")
def stored_series(spark, d):
    """The quarterly series from rolled-up rows stored by series keys."""
    path = shared_folder(spark, "rollup")
    series.write_rollup(fx.with_intervals(fx.incidence(spark, d, persons=False)), path, buckets=8)
    stored = series.series_from_rollup(read_bucketed(spark, path), timepoints=fx.TIMEPOINTS)
    return stored.withColumn("person_years_sum", F.round("person_years_sum", 5))


@query(
    "raw_rate_series",
    f"""SELECT incidence_start_date AS "Date", incidence AS "Forecast", incidence_95CI_lower AS "Lower_95_CI",
    incidence_95CI_upper AS "Upper_95_CI", 'Raw incidence' AS "Model", denominator_age_group AS age_group,
    denominator_sex AS sex, outcome_cohort_name AS outcome, timepoint, database_name AS cdm_name
    FROM {TIDY_SQL}, (SELECT DATE '1998-03-01' AS timepoint UNION ALL SELECT DATE '1998-04-01') p
    WHERE incidence IS NOT NULL AND analysis_interval = 'months'""",
)
def raw_rate_series(spark, d):
    return series.raw_rate_series(tidy_rates(spark, d, persons=False), fx.TIMEPOINTS)


@query(
    "design_terms",
    f"""SELECT {SERIES_SQL}, time, CAST(intrv AS DOUBLE) AS step, CAST(time AS DOUBLE) AS slope,
    CAST(intrv * time AS DOUBLE) AS step_slope, round(ln(person_years_sum), 6) AS "offset",
    LAG(n_events_sum) OVER (PARTITION BY {SERIES_SQL} ORDER BY incidence_start_date) AS lag_y FROM fx_sr_quarterly""",
)
def design_terms(spark, d):
    out = regression.design_terms(quarterly(spark, d), lagged=True)
    return out.select(
        *SERIES, "time", "step", "slope", "step_slope", F.round("offset", 6).alias("offset"), "lag_y"
    )


@query(
    "seasonal_basis",
    f"""SELECT {SERIES_SQL}, time, quarter, CASE WHEN quarter = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS season_1,
    CASE WHEN quarter = 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS season_2 FROM fx_sr_quarterly""",
)
def seasonal_basis(spark, d):
    rows = quarterly(spark, d).select(*SERIES, "time", "quarter")
    return rows.join(regression.seasonal_basis(spark), "quarter")


def _spline_sql(column: int) -> str:
    """A cubic B-spline on evenly spaced knots is a sum of truncated powers; periods are added up."""
    at = f"(quarter - 1) / 0.6 - {column - 3} + 5 * p - k"
    return f"""round(list_sum(list_transform(range(-2, 3), lambda p: list_sum(list_transform(range(0, 5), lambda k:
      [1, -4, 6, -4, 1][k + 1] * pow(greatest({at}, 0), 3) / 6)))), 9) + 0.0 AS season_{column}"""


@query("seasonal_spline", f"SELECT {SERIES_SQL}, time, quarter, {', '.join(map(_spline_sql, (1, 2, 3, 4)))} FROM fx_sr_quarterly")
def seasonal_spline(spark, d):
    rows = quarterly(spark, d).select(*SERIES, "time", "quarter")
    basis = regression.seasonal_basis(spark, "spline")
    rounded = {f"season_{i}": F.round(f"season_{i}", 9) + 0.0 for i in (1, 2, 3, 4)}
    return rows.join(basis, "quarter").withColumns(rounded)


# ---- regression ---------------------------------------------------------------------------

Z = "1.959963984540054"
LABEL_SQL = """CASE model WHEN 'with_intervention' THEN 'With Intervention' WHEN 'remove_intervention' THEN 'Remove Intervention'
    ELSE 'Step and slope only' END"""
FORECAST_KEYS_SQL = """denominator_age_group AS age_group, denominator_sex AS sex, outcome_cohort_name AS outcome, timepoint,
    database_name AS cdm_name"""


@query(
    "fit_segmented",
    f"""SELECT DISTINCT {SERIES_SQL}, model, status, n_obs, rank, df_residual, round(deviance, 6) AS deviance,
    round(dispersion, 6) AS dispersion FROM fx_fit WHERE NOT regexp_matches(outcome_cohort_name, 'URGENT')""",
)
def fit_segmented(spark, d):
    fits = regression.fit_segmented(quarterly(spark, d), gate="URGENT")
    return fits.select(
        *SERIES,
        "model",
        "status",
        "n_obs",
        "rank",
        "df_residual",
        F.round("deviance", 6).alias("deviance"),
        F.round("dispersion", 6).alias("dispersion"),
    )


# The spline spans the same levels, so its fits are those of the other basis.
@query(
    "fit_spline",
    f"""SELECT DISTINCT {SERIES_SQL}, model, status, n_obs, rank, df_residual, round(deviance, 6) AS deviance,
    round(dispersion, 6) AS dispersion FROM fx_fit""",
)
def fit_spline(spark, d):
    fits = regression.fit_segmented(quarterly(spark, d), season="spline")
    rounded = [F.round(c, 6).alias(c) for c in ("deviance", "dispersion")]
    return fits.select(*SERIES, "model", "status", "n_obs", "rank", "df_residual", *rounded)


@query(
    "fit_pooled",
    """SELECT model, status, CAST(n_obs AS BIGINT) AS n_obs, rank, CAST(df_residual AS BIGINT) AS df_residual,
    round(deviance, 4) AS deviance, round(dispersion, 6) AS dispersion, parameter, round(estimate, 7) AS estimate,
    round(std_error, 7) AS std_error, round(t_value, 4) AS t_value, round(p_value, 6) AS p_value FROM fx_pooled""",
)
def fit_pooled(spark, d):
    digits = {"deviance": 4, "dispersion": 6, "estimate": 7, "std_error": 7, "t_value": 4, "p_value": 6}
    out = pooled.fit_pooled(quarterly(spark, d), lagged=True)
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


# Deviances of large counts are compared by their leading digits.
@query(
    "fit_large_counts",
    f"""SELECT DISTINCT {SERIES_SQL}, model, status, n_obs, rank, df_residual,
    CASE WHEN status = 'ok' THEN round(log10(deviance), 6) END AS log_deviance FROM fx_fit_large""",
)
def fit_large_counts(spark, d):
    events = F.round(F.col("person_years_sum") * 100_000)
    large = quarterly(spark, d).withColumns({"n_events_sum": events, "person_years_sum": F.col("n_events_sum")})
    fits = regression.fit_segmented(large, gate=None)
    digits = F.when(F.col("status") == "ok", F.round(F.log10("deviance"), 6)).alias("log_deviance")
    return fits.select(*SERIES, "model", "status", "n_obs", "rank", "df_residual", digits)


# Predictions far outside the fitted rows reach 1e10, where fixed decimals ask for more digits than
# two independent solvers share. Rounded values are therefore compared in single precision.


def _band_sql(view: str) -> str:
    return f"""SELECT {SERIES_SQL}, model, status, incidence_start_date AS date, time, used,
    CAST(round(mu, 6) AS FLOAT) AS mu, round(se_link, 6) AS se_link,
    CAST(round(mu - {Z} * mu * se_link, 5) AS FLOAT) AS lower, CAST(round(mu + {Z} * mu * se_link, 5) AS FLOAT) AS upper
    FROM {view}"""


def _band(df):
    return df.select(
        *SERIES,
        "model",
        "status",
        "date",
        "time",
        "used",
        F.round("mu", 6).cast("float").alias("mu"),
        F.round("se_link", 6).alias("se_link"),
        F.round("lower", 5).cast("float").alias("lower"),
        F.round("upper", 5).cast("float").alias("upper"),
    )


RATE_NAMES = ("Forecast", "Lower_95_CI", "Upper_95_CI")


def _single(df):
    return df.withColumns({c: F.col(c).cast("float") for c in RATE_NAMES})


@query("predict_band", _band_sql("fx_fit"))
def predict_band(spark, d):
    return _band(regression.predict_band(regression.fit_segmented(quarterly(spark, d))))


@query("counterfactual", _band_sql("fx_fit_lagged") + " WHERE model = 'remove_intervention'")
def counterfactual(spark, d):
    fits = regression.fit_segmented(
        quarterly(spark, d), models=[regression.REMOVE_INTERVENTION], lagged=True
    )
    return _band(regression.counterfactual(fits))


def _forecast_sql(view: str, rounded: str) -> str:
    def rate(c):
        return rounded.format(f"({c}) * 100000 / person_years_sum")

    return f"""SELECT incidence_start_date AS "Date", {rate("mu")} AS "Forecast",
    {rate(f"mu - {Z} * mu * se_link")} AS "Lower_95_CI", {rate(f"mu + {Z} * mu * se_link")} AS "Upper_95_CI",
    {LABEL_SQL} AS "Model", {FORECAST_KEYS_SQL} FROM {view}"""


@query("forecast_table", _forecast_sql("fx_fit_lagged", "CAST(round_even({}, 2) AS FLOAT)"))
def forecast_table(spark, d):
    return _single(regression.forecast_table(quarterly(spark, d)))


@query("forecast_table_monthly", _forecast_sql("fx_fit_monthly", "CAST(round_even({}, 2) AS FLOAT)"))
def forecast_table_monthly(spark, d):
    return _single(regression.forecast_table_monthly(monthly(spark, d)))


@query(
    "forecast_plot_data",
    f"""WITH modelled AS ({_forecast_sql("fx_fit", "CAST(round({}, 4) AS FLOAT)")}),
    raw AS (SELECT incidence_start_date AS "Date", CAST(round(incidence, 4) AS FLOAT) AS "Forecast",
      CAST(round(incidence_95CI_lower, 4) AS FLOAT) AS "Lower_95_CI", CAST(round(incidence_95CI_upper, 4) AS FLOAT) AS "Upper_95_CI", 'Raw incidence' AS "Model", {FORECAST_KEYS_SQL}
      FROM {TIDY_SQL}, (SELECT DATE '1998-03-01' AS timepoint UNION ALL SELECT DATE '1998-04-01') p WHERE incidence IS NOT NULL),
    everything AS (SELECT * FROM modelled UNION ALL SELECT * FROM raw WHERE (age_group, sex, outcome, timepoint, cdm_name) IN
      (SELECT (age_group, sex, outcome, timepoint, cdm_name) FROM modelled))
    SELECT * EXCLUDE (r) FROM (SELECT *, dense_rank() OVER (PARTITION BY age_group, sex, outcome, timepoint, cdm_name
      ORDER BY "Date" DESC) AS r FROM everything) WHERE r > 5""",
)
def forecast_plot_data(spark, d):
    raw = series.raw_rate_series(tidy_rates(spark, d, persons=False), fx.TIMEPOINTS)
    out = regression.forecast_plot_data(quarterly(spark, d), raw)
    return _single(out.withColumns({c: F.round(c, 4) for c in RATE_NAMES}))


@query(
    "coefficient_diagnostics",
    f"""SELECT {SERIES_SQL}, {LABEL_SQL} AS "Model", parameter AS "Parameter", round_even(estimate, 2) AS "Estimate",
    round_even(std_error, 2) AS "Std_Error", round_even(t_value, 2) AS "Statistics", round_even(p_value, 2) AS "P_value",
    round_even(deviance, 2) AS deviance FROM fx_coefficients WHERE model <> 'step_slope'""",
)
def coefficient_diagnostics(spark, d):
    return regression.coefficient_diagnostics(regression.fit_segmented(quarterly(spark, d)))


# ---- correlation --------------------------------------------------------------------------


def _acf_sql(points: str) -> str:
    """Autocorrelation by definition: pairs of points that far apart. ``points``: keys, t, x."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in SERIES)
    keys = ", ".join(f"a.{k}" for k in SERIES)
    return f"""SELECT {keys}, CAST(b.t - a.t AS INTEGER) AS lag, SUM(a.dx * b.dx) / nullif(MAX(a.total), 0) AS acf
    FROM c a JOIN c b ON {on} AND b.t - a.t BETWEEN 0 AND least(floor(10 * log10(a.n)), a.n - 1)
    GROUP BY {keys}, b.t - a.t""", f"""c AS MATERIALIZED (SELECT *, SUM(dx * dx) OVER w AS total FROM
    (SELECT *, x - AVG(x) OVER w AS dx, COUNT(*) OVER w AS n FROM ({points}) WINDOW w AS (PARTITION BY {SERIES_SQL}))
    WINDOW w AS (PARTITION BY {SERIES_SQL}))"""


def acf_sql(points: str, digits: int = 6) -> str:
    body, centred = _acf_sql(points)
    return f"WITH {centred}, r AS ({body}) SELECT * REPLACE (round(acf, {digits}) AS acf) FROM r"


def pacf_sql(points: str, digits: int = 6) -> str:
    body, centred = _acf_sql(points)
    return f"""WITH RECURSIVE {centred}, r AS ({body}),
    l AS MATERIALIZED (SELECT {SERIES_SQL}, list(acf ORDER BY lag) AS r FROM r WHERE lag > 0 GROUP BY ALL),
    p AS (SELECT *, 1 AS k, [r[1]] AS phi, r[1] AS g FROM l
      UNION ALL SELECT * EXCLUDE (k, phi, g, gain), k + 1,
        list_append(list_transform(range(1, k + 1), lambda j: phi[j] - gain * phi[k + 1 - j]), gain), gain
      FROM (SELECT *, (r[k + 1] - list_dot_product(phi, list_reverse(r[1:k]))) / nullif(1 - list_dot_product(phi, r[1:k]), 0) AS gain
        FROM p WHERE k < len(r)))
    SELECT {SERIES_SQL}, CAST(k AS INTEGER) AS lag, round(g, {digits}) AS pacf FROM p"""


RATE_POINTS_SQL = f"SELECT {SERIES_SQL}, time AS t, n_events_sum * 100000 / person_years_sum AS x FROM fx_sr_quarterly"
RESIDUAL_POINTS_SQL = f"""SELECT {SERIES_SQL}, time AS t, sign(n_events_sum - mu) * sqrt(greatest(2 * (n_events_sum
    * ln(n_events_sum / mu) - (n_events_sum - mu)), 0)) AS x FROM fx_fit WHERE model = 'with_intervention' AND used AND status = 'ok'"""


def _rate_points(spark, d):
    rate = F.col("n_events_sum") * 100000 / F.col("person_years_sum")
    return quarterly(spark, d).select(*SERIES, F.col("time").alias("t"), rate.alias("x"))


def _residual_fits(spark, d):
    return regression.fit_segmented(quarterly(spark, d), models=[regression.WITH_INTERVENTION])


def _acf(points):
    return correlation.acf(points, SERIES, "t", "x")


@query("acf", acf_sql(RATE_POINTS_SQL))
def acf(spark, d):
    return _acf(_rate_points(spark, d)).withColumn("acf", F.round("acf", 6))


@query("pacf", pacf_sql(RATE_POINTS_SQL))
def pacf(spark, d):
    out = correlation.pacf(_acf(_rate_points(spark, d)), SERIES)
    return out.withColumn("pacf", F.round("pacf", 6))


# A deviance residual near zero is the root of a difference of nearly equal numbers, good to about
# 1e-8 on either side, so these two are compared to four digits.
@query("residual_acf", f"SELECT *, 'ok' AS status FROM ({acf_sql(RESIDUAL_POINTS_SQL, 4)})")
def residual_acf(spark, d):
    return regression.residual_acf(_residual_fits(spark, d)).withColumn("acf", F.round("acf", 4))


@query("residual_pacf", f"SELECT *, 'ok' AS status FROM ({pacf_sql(RESIDUAL_POINTS_SQL, 4)})")
def residual_pacf(spark, d):
    out = regression.residual_pacf(_residual_fits(spark, d))
    return out.withColumn("pacf", F.round("pacf", 4))
