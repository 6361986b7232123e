"""SQL twin of the segmented regression, sharing nothing with the numpy code.

Iteratively reweighted least squares written as a recursive query: each round orthogonalises the
seven term columns under the current weights by window sums (weighted Gram-Schmidt), which makes
the normal equations diagonal, and takes the new linear predictor from them. A column with nothing
left after orthogonalisation is aliased and counts for nothing.
"""

from __future__ import annotations

KEYS = "database_name, outcome_cohort_name, denominator_age_group, denominator_sex, timepoint"
TERMS = ("(Intercept)", "lag(n_events_sum)", "intrv", "time", "season_1", "season_2", "intrv:time")
P = len(TERMS)
ROUNDS = 14


def _sum(expr: str) -> str:
    return f"SUM({expr}) OVER s"


def _ratio(a: str, j: int) -> str:
    return f"CASE WHEN n{j} > 0 THEN {a} / n{j} ELSE 0 END"


def _orthogonal(inner: str) -> str:
    """Add q1..qp (orthogonal columns), n1..np (their weighted squared lengths), gj_k (products)."""
    sql = inner
    for j in range(1, P + 1):
        products = "".join(f", {_sum(f'w * x{j} * q{k}')} AS g{j}_{k}" for k in range(1, j))
        rest = "".join(f" - ({_ratio(f'g{j}_{k}', k)}) * q{k}" for k in range(1, j))
        sql = f"SELECT *{products}, {_sum(f'w * x{j} * x{j}')} AS o{j} FROM ({sql}) WINDOW s AS (PARTITION BY sid)"
        sql = f"SELECT *, x{j}{rest} AS q{j} FROM ({sql})"
        sql = f"SELECT *, {_sum(f'w * q{j} * q{j}')} AS l{j} FROM ({sql}) WINDOW s AS (PARTITION BY sid)"
        sql = f"SELECT *, CASE WHEN l{j} > 1e-18 * o{j} THEN l{j} ELSE 0 END AS n{j} FROM ({sql})"
    return sql


def _solved(inner: str) -> str:
    """Add c1..cp (coefficients of the orthogonal columns) and eta."""
    sums = ", ".join(f"{_sum(f'w * z * q{j}')} AS h{j}" for j in range(1, P + 1))
    sql = f"SELECT *, {sums} FROM ({_orthogonal(inner)}) WINDOW s AS (PARTITION BY sid)"
    cs = ", ".join(f"{_ratio(f'h{j}', j)} AS c{j}" for j in range(1, P + 1))
    eta = " + ".join(f"c{j} * q{j}" for j in range(1, P + 1))
    return f"SELECT *, {eta} AS eta FROM (SELECT *, {cs} FROM ({sql}))"


def _weighted(source: str) -> str:
    # Rows outside the fit carry weight 0 and a harmless working value.
    return f"""SELECT *, CASE WHEN used THEN mu ELSE 0 END AS w,
      CASE WHEN used THEN ln(mu) - off + (y - mu) / mu ELSE 0 END AS z FROM {source}"""


def fit_sql(series: str, lagged: bool, together: str = f"{KEYS}, model") -> str:
    """All rows of all models: state after the last round, with the orthogonal columns in place.

    Rows equal in ``together`` are fitted as one.
    """
    own_lag = f"{'TRUE' if lagged else 'FALSE'} AND model <> 'step_slope'"
    xs = ", ".join(f"x{j}" for j in range(1, P + 1))
    return f"""WITH RECURSIVE m AS MATERIALIZED (
  SELECT s.*, model, LAG(n_events_sum) OVER (PARTITION BY {KEYS}, model ORDER BY time) AS lag_y,
    row_number() OVER (ORDER BY {KEYS}, model, time) AS rid, dense_rank() OVER (ORDER BY {together}) AS sid
  FROM {series} s, (VALUES ('with_intervention'), ('remove_intervention'), ('step_slope')) v(model)),
d AS MATERIALIZED (
  SELECT rid, sid, n_events_sum AS y, ln(person_years_sum) AS off,
    (model <> 'remove_intervention' OR incidence_start_date <= timepoint) AND NOT ({own_lag} AND lag_y IS NULL) AS used,
    1.0::DOUBLE AS x1, CASE WHEN {own_lag} THEN coalesce(lag_y, 0) ELSE 0.0 END::DOUBLE AS x2,
    CASE WHEN model <> 'remove_intervention' THEN intrv ELSE 0 END::DOUBLE AS x3, time::DOUBLE AS x4,
    CASE WHEN model <> 'step_slope' AND quarter = 2 THEN 1 ELSE 0 END::DOUBLE AS x5,
    CASE WHEN model <> 'step_slope' AND quarter = 3 THEN 1 ELSE 0 END::DOUBLE AS x6,
    CASE WHEN model <> 'remove_intervention' THEN intrv * time ELSE 0 END::DOUBLE AS x7
  FROM m),
it(rid, round, sid, y, off, used, {xs}, mu) USING KEY (rid) AS (
  SELECT rid, 0, sid, y, off, used, {xs}, y + 0.1 FROM d
  UNION
  SELECT rid, round + 1, sid, y, off, used, {xs}, exp(CASE WHEN used THEN off + eta ELSE 0 END)
  FROM ({_solved(_weighted(f"(SELECT * FROM it WHERE round < {ROUNDS})"))})),
final AS (
  SELECT *, exp(off + eta) AS mu_all FROM ({_solved(_weighted("it"))})),
stats AS (
  SELECT *, CAST({" + ".join(f"(n{j} > 0)::INTEGER" for j in range(1, P + 1))} AS INTEGER) AS rank,
    CAST(SUM(used::INTEGER) OVER s AS INTEGER) AS n_obs,
    2 * SUM(CASE WHEN used THEN mu_all * CASE WHEN y = 0 THEN 1.0
      WHEN abs(y / mu_all - 1) < 1e-3 THEN pow((y - mu_all) / mu_all, 2) / 2 - pow((y - mu_all) / mu_all, 3) / 6
        + pow((y - mu_all) / mu_all, 4) / 12 - pow((y - mu_all) / mu_all, 5) / 20
      ELSE y / mu_all * ln(y / mu_all) - (y - mu_all) / mu_all END ELSE 0 END) OVER s AS deviance,
    SUM(CASE WHEN used THEN (y - mu_all) * (y - mu_all) / mu_all ELSE 0 END) OVER s AS pearson
  FROM final WINDOW s AS (PARTITION BY sid)),
scaled AS (
  SELECT *, n_obs - rank AS df_residual, CASE WHEN n_obs > rank THEN pearson / (n_obs - rank) END AS dispersion,
    {" + ".join(_ratio(f"q{j} * q{j}", j).join("()") for j in range(1, P + 1))} AS spread
  FROM stats)
SELECT m.* EXCLUDE (sid), s.sid, s.used, s.n_obs, s.rank, CASE WHEN n_obs > 0 THEN s.df_residual END AS df_residual,
  CASE WHEN n_obs > 0 THEN s.deviance END AS deviance, s.dispersion, s.off,
  CASE WHEN n_obs = 0 THEN 'no_rows' WHEN s.df_residual = 0 THEN 'saturated' ELSE 'ok' END AS status,
  CASE WHEN n_obs > 0 AND NOT ({own_lag} AND lag_y IS NULL) THEN s.mu_all END AS mu,
  CASE WHEN n_obs > 0 AND NOT ({own_lag} AND lag_y IS NULL) THEN sqrt(dispersion * spread) END AS se_link,
  {", ".join(f"s.c{j}, s.n{j}" for j in range(1, P + 1))},
  {", ".join(f"s.g{j}_{k}" for j in range(2, P + 1) for k in range(1, j))}
FROM scaled s JOIN m USING (rid)"""


def coefficient_sql(fit_view: str, keys: str = KEYS) -> str:
    """Coefficients on the original terms: back-substitution through the orthogonalisation."""
    inverse: dict[tuple[int, int], str] = {}
    levels = [f"SELECT DISTINCT ON (sid) * FROM {fit_view} WHERE n_obs > 0"]
    ratios = ", ".join(
        f"{_ratio(f'g{j}_{k}', k)} AS r{k}_{j}" for j in range(2, P + 1) for k in range(1, j)
    )
    levels.append(f"SELECT *, {ratios} FROM ({levels[-1]})")
    for j in range(P, 0, -1):
        new = []
        for k in range(j, P + 1):
            inverse[j, k] = "1.0" if j == k else f"i{j}_{k}"
            if j < k:
                parts = " - ".join(f"r{j}_{m} * {inverse[m, k]}" for m in range(j + 1, k + 1))
                new.append(f"-({parts.replace(' - ', ' + ')}) AS i{j}_{k}")
        if new:
            levels.append(f"SELECT *, {', '.join(new)} FROM ({levels[-1]})")
    rows = []
    for j in range(1, P + 1):
        span = range(j, P + 1)
        estimate = " + ".join(f"{inverse[j, k]} * c{k}" for k in span)
        variance = " + ".join(
            f"CASE WHEN n{k} > 0 THEN {inverse[j, k]} * {inverse[j, k]} / n{k} ELSE 0 END" for k in span
        )
        rows.append(
            f"SELECT {keys}, model, {j} AS place, '{TERMS[j - 1]}' AS parameter, deviance, df_residual, "
            f"{estimate} AS estimate, sqrt(dispersion * ({variance})) AS std_error FROM b WHERE n{j} > 0"
        )
    union = "\n  UNION ALL ".join(rows)
    # Student t with whole degrees of freedom has a finite series in the angle atan(t / sqrt(df)).
    half = "CAST(df_residual // 2 AS BIGINT)"
    even = f"""sin(a) * list_sum(list_transform(range(0, {half}), lambda i:
      exp(lgamma(i + 0.5) - lgamma(0.5) - lgamma(i + 1.0)) * pow(cos(a), 2 * i)))"""
    odd = f"""2 / pi() * (a + CASE WHEN df_residual > 1 THEN sin(a) * list_sum(list_transform(range(0, {half}), lambda i:
      exp(lgamma(i + 1.0) + lgamma(1.5) - lgamma(i + 1.5)) * pow(cos(a), 2 * i + 1))) ELSE 0 END)"""
    return f"""WITH b AS MATERIALIZED ({levels[-1]}),
u AS ({union}),
t AS (SELECT *, estimate / std_error AS t_value, atan(abs(estimate / std_error) / sqrt(df_residual)) AS a FROM u)
SELECT * EXCLUDE (a), 1 - CASE WHEN df_residual % 2 = 0 THEN {even} ELSE {odd} END AS p_value FROM t"""
