"""Segmented regression against Spark ML, published t tables and hand-made edge cases."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from strataflow.functions.quasipoisson import OK, fit_block
from strataflow.functions.student_t import two_sided_p
from strataflow.plans import regression as rg

SCHEMA = (
    "database_name string, outcome_cohort_name string, denominator_age_group string, denominator_sex string, "
    "timepoint date, incidence_start_date date, quarter int, n_events_sum double, person_years_sum double, intrv int, time int"
)


def _rows(n, cut, outcome="x", y=None, pt=None, start=2015, seed=0):
    rng = np.random.default_rng(seed)
    tp = dt.date(start + cut // 4, cut % 4 * 3 + 1, 1)
    out = []
    for i in range(n):
        d = dt.date(start + i // 4, i % 4 * 3 + 1, 1)
        mean = math.exp(3 + 0.02 * i + 0.3 * (i % 4 == 1) - (0.4 if i >= cut else 0))
        count = float(rng.poisson(mean)) + 1 if y is None else float(y[i])
        time = 1000.0 + 37 * (i % 5) if pt is None else float(pt[i])
        out.append(("A", outcome, "all", "Both", tp, d, i % 4 + 1, count, time, int(i >= cut), i + 1))
    return out


def _frame(spark, *blocks):
    return spark.createDataFrame([r for b in blocks for r in b], SCHEMA)


@pytest.mark.parametrize("model,lagged", [("step_slope", False), ("with_intervention", False), ("with_intervention", True), ("remove_intervention", True)])
def test_agrees_with_spark_ml(spark, model, lagged):
    df = _frame(spark, _rows(24, 14))
    fits = rg.fit_segmented(df, models=[model], lagged=lagged)
    ours = {r.parameter: r for r in rg.coefficients(fits).collect()}

    terms = rg.design_terms(df, lagged=True).join(rg.seasonal_basis(spark), "quarter")
    if model == "remove_intervention":
        terms = terms.filter("incidence_start_date <= timepoint")
    if lagged:
        terms = terms.filter("lag_y is not null")
    names = {"lag_y": "lag(n_events_sum)", "step": "intrv", "slope": "time", "season_1": "season_1", "season_2": "season_2", "step_slope": "intrv:time"}
    cols = [c for c, n in names.items() if n in ours]
    data = VectorAssembler(inputCols=cols, outputCol="f").transform(terms)
    # Variance power 1 with a log link is the quasi-Poisson family: free dispersion.
    glm = GeneralizedLinearRegression(
        family="tweedie", variancePower=1.0, linkPower=0.0, offsetCol="offset", labelCol="n_events_sum", featuresCol="f", tol=1e-12
    ).fit(data)
    s = glm.summary
    theirs = dict(zip([names[c] for c in cols], zip(glm.coefficients, s.coefficientStandardErrors, s.tValues, s.pValues)))
    theirs["(Intercept)"] = (glm.intercept, s.coefficientStandardErrors[-1], s.tValues[-1], s.pValues[-1])
    assert set(theirs) == set(ours)
    for name, expected in theirs.items():
        r = ours[name]
        assert np.allclose([r.estimate, r.std_error, r.t_value, r.p_value], expected, rtol=1e-6, atol=1e-8), name
    assert math.isclose(ours["time"].deviance, s.deviance, rel_tol=1e-8)
    assert math.isclose(ours["time"].dispersion, s.dispersion, rel_tol=1e-8)


@pytest.mark.parametrize("df,t", [(1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (30, 2.042), (120, 1.980)])
def test_published_t_quantiles(df, t):
    assert abs(two_sided_p(np.array([t]), np.array([df]))[0] - 0.05) < 2e-4
    assert two_sided_p(np.array([0.0]), np.array([df]))[0] == pytest.approx(1.0)


def test_statuses_of_series_that_cannot_be_fitted(spark):
    df = _frame(
        spark,
        _rows(24, 14, "fine"),
        _rows(1, 4, "single"),
        _rows(8, 0, "all after"),
        _rows(12, 6, "no time", pt=[0.0] + [100.0] * 11),
        _rows(24, 14, "COVID-19 infection"),
    )
    out = {(r.outcome_cohort_name, r.model): r.status for r in rg.fit_segmented(df, lagged=True).collect()}
    assert not any(o.startswith("COVID") for o, _ in out)
    assert {s for (o, _), s in out.items() if o == "fine"} == {"ok"}
    assert out["single", "with_intervention"] == "no_rows" and out["single", "step_slope"] == "saturated"
    assert out["all after", "remove_intervention"] == "no_rows" and out["all after", "step_slope"] == "ok"
    assert out["no time", "step_slope"] == "zero_person_time"


def test_a_saturated_fit_reproduces_its_input_without_a_band(spark):
    df = _frame(spark, _rows(4, 2))
    rows = rg.predict_band(rg.fit_segmented(df, models=["step_slope"])).collect()
    assert {r.status for r in rows} == {"saturated"}
    assert all(abs(r.mu - r.y) < 1e-6 and r.lower is None for r in rows)


def test_aliased_terms_are_left_out(spark):
    # No quarter 3 in the data: the second seasonal column is empty.
    rows = [r for r in _rows(32, 20) if r[6] != 3]
    df = _frame(spark, [(*r[:-1], i) for i, r in enumerate(rows, start=1)])
    fit = rg.fit_segmented(df, models=["with_intervention"])
    names = [r.parameter for r in rg.coefficients(fit).collect()]
    assert "season_1" in names and "season_2" not in names
    row = fit.collect()[0]
    assert row.rank == 5 and row.df_residual == row.n_obs - 5
    full = rg.fit_segmented(df, models=["with_intervention"], season="full")
    assert full.collect()[0].rank == 6


def test_counterfactual_equals_the_fit_before_the_timepoint_and_continues_it(spark):
    df = _frame(spark, _rows(24, 14))
    rows = rg.counterfactual(rg.fit_segmented(df)).orderBy("time").collect()
    assert len(rows) == 24 and all(r.mu is not None for r in rows)
    before = [r for r in rows if r.used]
    assert len(before) == 15  # the timepoint's own row belongs to the time before when it is kept
    assert abs(sum(r.y - r.mu for r in before)) < 1e-6
    assert all(abs((r.upper - r.mu) - (r.mu - r.lower)) < 1e-9 for r in rows)


def test_lagged_forecasts_lose_their_first_row_only(spark):
    out = rg.forecast_table(_frame(spark, _rows(24, 14)))
    missing = {(r.Model, r.Date) for r in out.filter(F.col("Forecast").isNull()).collect()}
    assert missing == {("With Intervention", dt.date(2015, 1, 1)), ("Remove Intervention", dt.date(2015, 1, 1))}
    assert out.count() == 72


def test_all_series_of_a_block_are_fitted_as_they_are_alone(spark):
    blocks = [_rows(8 + 5 * i, 5 + 2 * i, f"o{i}", seed=i) for i in range(6)]
    together = {
        (r.outcome_cohort_name, r.model): (r.deviance, r.dispersion, r.rank)
        for r in rg.fit_segmented(_frame(spark, *blocks).coalesce(1)).collect()
    }
    for i, b in enumerate(blocks):
        for r in rg.fit_segmented(_frame(spark, b)).collect():
            d, disp, rank = together[r.outcome_cohort_name, r.model]
            assert rank == r.rank and math.isclose(d, r.deviance, rel_tol=1e-9, abs_tol=1e-9)
            assert (disp is None) == (r.dispersion is None)


def test_blocks_cover_every_series_once():
    lengths = np.array([5, 1, 300, 0, 7, 7, 120000, 3])
    seen = [i for members in rg._blocks(lengths, 8) for i in members]
    assert sorted(seen) == list(range(len(lengths)))


def test_portions_of_a_batch_give_the_same_fits(monkeypatch):
    lengths = [9, 14, 30, 7, 22]
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    columns = {c: [] for c in ("time", "date", "quarter", "intrv", "before", "y", "pt")}
    for i, n in enumerate(lengths):
        for r in _rows(n, n // 2, seed=i):
            values = (r[10], r[5], r[6], r[9], int(r[5] <= r[4]), r[7], r[8])
            for c, v in zip(columns, values):
                columns[c].append(v)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in columns.values()]
    batch = pa.RecordBatch.from_arrays([pa.array(list("abcde")), *lists], names=["k", *columns])

    def run():
        parts = list(rg._portions(batch))
        out = [o for p in parts for o in rg._fit_batch(p, ["k"], rg.MODELS, True, "wrap", 1e-12, 25)]
        rows = [r for o in out for r in o.to_pylist()]
        return len(parts), sorted(rows, key=lambda r: (r["k"], r["model"]))

    whole = run()
    monkeypatch.setattr(rg, "_PORTION_ROWS", 25)
    cut = run()
    assert whole[0] == 1 and cut[0] == 4
    for a, b in zip(whole[1], cut[1]):
        assert (a["k"], a["model"], a["status"], a["rank"]) == (b["k"], b["model"], b["status"], b["rank"])
        assert np.allclose(a["deviance"], b["deviance"], rtol=1e-8, atol=1e-9)
        assert [r["date"] for r in a["fitted"]] == [r["date"] for r in b["fitted"]]
        mu_a, mu_b = (np.array([r["mu"] for r in x["fitted"]], dtype=float) for x in (a, b))
        assert np.allclose(mu_a, mu_b, rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("size", [1e2, 1e5, 1e6, 1e8])
def test_counts_of_any_size_converge(spark, size):
    rng = np.random.default_rng(int(math.log10(size)))
    blocks = []
    for k in range(60):
        mean = size * np.exp(0.01 * np.arange(24) + 0.1 * rng.normal())
        blocks.append(_rows(24, 14, outcome=f"o{k}", y=rng.poisson(mean)))
    df = _frame(spark, *blocks)
    fits = rg.fit_segmented(df).cache()
    assert {r.status for r in fits.select("status").distinct().collect()} == {"ok"}
    assert rg.residual_acf(fits).select("outcome_cohort_name").distinct().count() == 60
    assert rg.residual_pacf(fits).select("outcome_cohort_name").distinct().count() == 60
    one = _frame(spark, blocks[0])
    row = {r.parameter: r.estimate for r in rg.coefficients(rg.fit_segmented(one, models=["step_slope"])).collect()}
    data = VectorAssembler(inputCols=["step", "slope", "step_slope"], outputCol="f").transform(rg.design_terms(one))
    glm = GeneralizedLinearRegression(
        family="tweedie", variancePower=1.0, linkPower=0.0, offsetCol="offset", labelCol="n_events_sum", featuresCol="f", tol=1e-12
    ).fit(data)
    theirs = [glm.intercept, *glm.coefficients]
    ours = [row[n] for n in ("(Intercept)", "intrv", "time", "intrv:time")]
    assert np.allclose(ours, theirs, rtol=1e-6, atol=1e-8)
    fits.unpersist()


def test_residuals_of_a_fit_that_did_not_converge_stay(spark):
    fits = rg.fit_segmented(_frame(spark, _rows(24, 14)), models=["with_intervention"], max_iterations=1)
    assert fits.collect()[0].status == "not_converged"
    out = rg.residual_series(fits).collect()
    assert len(out) == 24 and {r.status for r in out} == {"not_converged"}
    assert {r.status for r in rg.residual_acf(fits).collect()} == {"not_converged"}


def _spiky(mean, size, second=False, n_series=1500, n=28, seed=7):
    """Lagged series with spikes of up to 10^size times the rest: plain reweighting overshoots on some of them."""
    rng = np.random.default_rng(seed)
    y = rng.poisson(mean, (n_series, n)).astype(float) + 1
    for k in range(n_series):
        for _ in range(rng.integers(1, 3)):
            y[k, rng.integers(n)] *= 10.0 ** rng.uniform(1, size)
        if second:
            y[k, rng.integers(n)] += 10.0 ** rng.uniform(1, 5)
    y = np.round(y)
    pt = 1000.0 + rng.integers(0, 100, (n_series, n))
    time = np.tile(np.arange(1.0, n + 1), (n_series, 1))
    after = (np.arange(n) >= rng.integers(8, 20, n_series)[:, None]).astype(float)
    lag = np.concatenate([np.full((n_series, 1), np.nan), y[:, :-1]], 1)
    season = [np.tile((np.arange(n) % 4 == q) * 1.0, (n_series, 1)) for q in (1, 2)]
    x = np.stack([np.ones_like(time), lag, after, time, *season, after * time], 2)
    return x, y, pt, np.isfinite(x).all(2)


def _at_minimum(fit, x, y, used):
    """Whether the residuals are orthogonal to every term, relative to the sum's size."""
    rest = np.where(used, y - fit.mu, 0.0)
    terms = np.where(used[:, :, None], np.nan_to_num(x), 0.0)
    slope = np.abs(np.einsum("snk,sn->sk", terms, rest))
    return (slope <= 1e-6 * np.einsum("snk,sn->sk", np.abs(terms), np.where(used, y + fit.mu, 0.0)) + 1e-9).all(1)


@pytest.mark.parametrize("mean", [2, 20])
def test_spiky_series_converge_by_shortened_steps(mean, recwarn):
    x, y, pt, used = _spiky(mean, 4)
    fit = fit_block(x, y, pt, used, 1e-8, 50)
    ok = fit.status == OK
    assert ok.mean() > 0.99 and (fit.status[~ok] == rg.NOT_CONVERGED).all() and fit.iterations[ok].max() < 50
    assert _at_minimum(fit, x, y, used)[ok].all()
    assert not [w for w in recwarn if issubclass(w.category, RuntimeWarning)]


def test_series_no_step_improves_claim_no_answer(recwarn):
    """Spikes of a million and their lags pull some means to e^-150 and less, where rounding leaves no way down."""
    x, y, pt, used = _spiky(3, 6, second=True)
    fit = fit_block(x, y, pt, used, 1e-8, 50)
    ok = fit.status == OK
    assert 0.9 < ok.mean() < 1 and (fit.status[~ok] == rg.NOT_CONVERGED).all()
    assert _at_minimum(fit, x, y, used)[ok].mean() > 0.99
    assert not [w for w in recwarn if issubclass(w.category, RuntimeWarning)]


def test_a_round_limit_is_a_status(recwarn):
    x, y, pt, used = _spiky(2, 4)
    fit = fit_block(x, y, pt, used, 1e-8, 3)
    short = fit.status == rg.NOT_CONVERGED
    assert short.any() and (fit.iterations[short] == 3).all()
    assert not [w for w in recwarn if issubclass(w.category, RuntimeWarning)]


def test_halving_leaves_ordinary_fits_alone():
    """Large and small counts converge to the fit of a plain Newton iteration."""
    rng = np.random.default_rng(3)
    n = 40
    x = np.stack([np.ones(n), np.arange(n) / n, np.arange(n) % 4 == 1], 1)[None]
    for scale in (1.0, 1e6):
        y = rng.poisson(scale * np.exp(1 + x[0] @ [0.5, 1.0, 0.3])).astype(float)[None]
        fit = fit_block(x, y, np.ones((1, n)), np.ones((1, n), bool), 1e-8, 50)
        b = np.array([math.log(y.mean()), 0.0, 0.0])
        for _ in range(60):
            mu = np.exp(x[0] @ b)
            b = b + np.linalg.solve(x[0].T @ (x[0] * mu[:, None]), x[0].T @ (y[0] - mu))
        assert fit.status[0] == OK and np.allclose(fit.estimate[0], b, rtol=1e-9)
