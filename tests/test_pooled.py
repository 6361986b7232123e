"""The pooled fit against Spark ML, the periodic spline against a plain recursion."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from strataflow.functions.splines import periodic_basis
from strataflow.plans import pooled
from strataflow.plans import regression as rg

SCHEMA = (
    "database_name string, outcome_cohort_name string, denominator_age_group string, denominator_sex string, "
    "timepoint date, incidence_start_date date, quarter int, n_events_sum double, person_years_sum double, intrv int, time int"
)


def _series(n_series=12, n=26, scale=1.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n_series):
        sex, cut = ("Male", "Female", None)[s % 3], 12 + s % 4
        tp = dt.date(2010 + cut // 4, cut % 4 * 3 + 1, 1)
        for i in range(n):
            d = dt.date(2010 + i // 4, i % 4 * 3 + 1, 1)
            mean = scale * math.exp(2 + 0.03 * i + 0.4 * (sex == "Male") - 0.3 * (i >= cut) + 0.2 * (i % 4 == 1))
            rows.append((f"D{s}", "x", "all", sex, tp, d, i % 4 + 1, float(rng.poisson(mean)), 900.0 + 13 * (i % 7), int(i >= cut), i + 1))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_series(), SCHEMA)


def _glm(rows, columns):
    data = VectorAssembler(inputCols=columns, outputCol="f").transform(rows)
    fit = GeneralizedLinearRegression(
        family="tweedie", variancePower=1.0, linkPower=0.0, offsetCol="offset", labelCol="n_events_sum", featuresCol="f", tol=1e-13
    ).fit(data)
    s = fit.summary
    values = zip([*fit.coefficients, fit.intercept], s.coefficientStandardErrors, s.tValues, s.pValues)
    return dict(zip([*columns, "(Intercept)"], values)), s


@pytest.mark.parametrize("lagged", [False, True])
def test_equals_spark_ml(spark, frame, lagged):
    got = {}
    for r in pooled.fit_pooled(frame, lagged=lagged, effects=["denominator_sex"]).collect():
        got.setdefault(r.model, {})[r.parameter] = r
    terms = rg.design_terms(frame, lagged=True).join(rg.seasonal_basis(spark), "quarter")
    sex = F.coalesce("denominator_sex", F.lit("NA"))
    terms = terms.withColumns({"male": (sex == "Male").cast("double"), "na": (sex == "NA").cast("double")})
    names = {"lag_y": "lag(n_events_sum)", "step": "intrv", "slope": "time", "season_1": "season_1", "season_2": "season_2", "step_slope": "intrv:time", "male": "denominator_sex: Male", "na": "denominator_sex: NA"}
    for model, fits in got.items():
        rows = terms.filter("incidence_start_date <= timepoint") if model == rg.REMOVE_INTERVENTION else terms
        rows = rows.filter("lag_y is not null") if lagged and model != rg.STEP_SLOPE else rows
        want, s = _glm(rows, [c for c, n in names.items() if n in fits])
        assert {names.get(c, c) for c in want} == set(fits)
        for c, (estimate, error, t, p) in want.items():
            r = fits[names.get(c, c)]
            assert (r.status, r.n_obs, r.df_residual) == ("ok", rows.count(), s.residualDegreeOfFreedom)
            assert r.estimate == pytest.approx(estimate, rel=1e-6, abs=1e-9) and r.std_error == pytest.approx(error, rel=1e-6)
            assert r.t_value == pytest.approx(t, rel=1e-5, abs=1e-7) and r.p_value == pytest.approx(p, abs=1e-7)
            assert r.deviance == pytest.approx(s.deviance, rel=1e-8)


def test_one_series_pooled_is_its_own_fit(spark):
    one = spark.createDataFrame(_series(1, scale=300.0), SCHEMA)
    alone = {(r.model, r.parameter): r for r in rg.coefficients(rg.fit_segmented(one, lagged=True)).collect()}
    together = pooled.fit_pooled(one, lagged=True).collect()
    assert {(r.model, r.parameter) for r in together} == set(alone)
    for r in together:
        a = alone[r.model, r.parameter]
        assert r.estimate == pytest.approx(a.estimate, rel=1e-8) and r.p_value == pytest.approx(a.p_value, abs=1e-9)


def test_aliased_terms_and_odd_rows(spark, frame):
    """A level that repeats another term, rows without person-time, counts or time, and no rows at all."""
    twice = frame.withColumn("again", F.col("denominator_sex"))
    got = pooled.fit_pooled(twice, models=[rg.STEP_SLOPE], effects=["denominator_sex", "again"]).collect()
    assert [r.parameter for r in got] == ["(Intercept)", "intrv", "time", "intrv:time", "denominator_sex: Male", "denominator_sex: NA"]
    bad = spark.createDataFrame(
        [("Z", "x", "all", "Male", dt.date(2013, 1, 1), dt.date(2013, 4, 1), 2, y, pt, 1, t) for y, pt, t in ((1.0, 0.0, 3), (None, 5.0, 3), (1.0, None, 3), (1.0, 5.0, None))],
        SCHEMA,
    )
    a, b = (sorted(pooled.fit_pooled(x, models=[rg.STEP_SLOPE]).collect()) for x in (frame, frame.unionByName(bad)))
    assert [r.n_obs for r in a] == [r.n_obs for r in b]
    assert all(x.estimate == pytest.approx(y.estimate, rel=1e-9) for x, y in zip(a, b))
    none = pooled.fit_pooled(frame.limit(0)).collect()
    assert [(r.model, r.status, r.n_obs, r.parameter) for r in none] == [(m, "no_rows", 0, None) for m in rg.MODELS]


def test_a_spike_is_approached_by_halved_steps(spark):
    rows = [(*r[:7], r[7] * (1e6 if r[0] == "D3" and r[10] == 9 else 1), *r[8:]) for r in _series()]
    got = pooled.fit_pooled(spark.createDataFrame(rows, SCHEMA), models=[rg.WITH_INTERVENTION], lagged=True).collect()
    assert {r.status for r in got} == {"ok"}
    short = pooled.fit_pooled(spark.createDataFrame(rows, SCHEMA), models=[rg.WITH_INTERVENTION], lagged=True, max_iterations=2).collect()
    assert {r.status for r in short} == {"not_converged"} and all(math.isfinite(r.estimate) for r in short)


def test_every_round_reads_the_written_rows_once(frame, monkeypatch):
    passes = []
    real = pooled._sums
    monkeypatch.setattr(pooled, "_sums", lambda rows, models, fitting: passes.append(len(models)) or real(rows, models, fitting))
    pooled.fit_pooled(frame)
    assert passes[0] == 3 and len(passes) < 20


# ---- the spline -----------------------------------------------------------------------------


def _plain_spline(x, i, degree, knots):
    if degree == 0:
        return float(knots[i] <= x < knots[i + 1])
    a = (x - knots[i]) / (knots[i + degree] - knots[i]) * _plain_spline(x, i, degree - 1, knots)
    return a + (knots[i + degree + 1] - x) / (knots[i + degree + 1] - knots[i + 1]) * _plain_spline(x, i + 1, degree - 1, knots)


@pytest.mark.parametrize("df, degree, upper", [(4, 3, 4.0), (5, 3, 5.0), (4, 2, 4.0), (7, 3, 13.0)])
def test_the_basis_equals_a_plain_recursion_and_is_periodic(df, degree, upper):
    n, step = df + 1, (upper - 1) / (df + 1)
    knots = [1 + k * step for k in range(-degree - n, 2 * n + degree + 1)]
    x = np.linspace(1, upper, 31)[:-1]
    want = np.zeros((len(x), n))
    for i in range(len(knots) - degree - 1):
        want[:, (i - n) % n] += [_plain_spline(v, i, degree, knots) for v in x]
    got = periodic_basis(x, df, degree, 1.0, upper)
    assert np.allclose(got, want[:, 1:], atol=1e-12)
    assert np.allclose(periodic_basis(x + 3 * (upper - 1), df, degree, 1.0, upper), got, atol=1e-9)
    for shift in (1e-6, 1e-3):  # the ends join smoothly
        ends = periodic_basis([1 + shift, upper - shift, 1.0], df, degree, 1.0, upper)
        assert np.allclose(ends[0] - ends[2], -(ends[1] - ends[2]), atol=20 * shift**2 / step**2)
    with pytest.raises(ValueError):
        periodic_basis(x, 2, 3)


def test_fitted_values_do_not_depend_on_the_seasonal_basis(frame):
    fits = {m: rg.fit_segmented(frame, season=m, models=[rg.WITH_INTERVENTION]) for m in ("wrap", "spline")}
    rows = {m: {tuple(r)[:6]: r.mu for r in rg.predict_band(f).select(*rg.SERIES, "time", "mu").collect()} for m, f in fits.items()}
    assert rows["wrap"].keys() == rows["spline"].keys()
    assert all(rows["spline"][k] == pytest.approx(v, rel=1e-9) for k, v in rows["wrap"].items())
    # The seasonal coefficients are those of the spline: they rebuild the quarters' levels.
    by = {m: {(r.database_name, r.parameter): r.estimate for r in rg.coefficients(f).collect()} for m, f in fits.items()}
    basis = rg.season_basis("spline")
    for k in range(12):
        c = by["spline"]
        level = {q: c[f"D{k}", "(Intercept)"] + sum(c.get((f"D{k}", f"season_{i + 1}"), 0) * b for i, b in enumerate(basis[q])) for q in basis}
        assert level[1] == pytest.approx(level[4]) and level[1] == pytest.approx(by["wrap"][f"D{k}", "(Intercept)"], rel=1e-8)
        assert level[2] - level[1] == pytest.approx(by["wrap"][f"D{k}", "season_1"], rel=1e-6)
