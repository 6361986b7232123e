"""Autocorrelation by definition, partial autocorrelation by the Yule-Walker equations."""

import numpy as np
import pytest

from strataflow.plans.correlation import acf, pacf


def _acf_by_hand(x, last):
    d = np.asarray(x) - np.mean(x)
    return [float((d[: len(d) - k] * d[k:]).sum() / (d * d).sum()) for k in range(last + 1)]


def _pacf_by_hand(r):
    out = []
    for k in range(1, len(r)):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        out.append(float(np.linalg.solve(toeplitz, np.array(r[1 : k + 1]))[-1]))
    return out


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    return {f"s{n}": list(np.cumsum(rng.normal(size=n))) for n in (2, 3, 11, 26, 120)}


def test_acf_and_pacf(spark, series):
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x, start=1)]
    np.random.default_rng(1).shuffle(rows)
    df = spark.createDataFrame([(k, int(t), float(v)) for k, t, v in rows], "k string, t int, x double")
    r = acf(df, ["k"], "t", "x")
    got = {(row.k, row.lag): row.acf for row in r.collect()}
    part = {(row.k, row.lag): row.pacf for row in pacf(r, ["k"]).collect()}
    for k, x in series.items():
        last = min(int(np.floor(10 * np.log10(len(x)))), len(x) - 1)
        expected = _acf_by_hand(x, last)
        assert [got[k, i] for i in range(last + 1)] == pytest.approx(expected, abs=1e-10)
        assert (k, last + 1) not in got
        assert [part[k, i] for i in range(1, last + 1)] == pytest.approx(_pacf_by_hand(expected), abs=1e-7)


def test_constant_series_has_no_correlation(spark):
    df = spark.createDataFrame([("c", t, 2.0) for t in range(1, 9)], "k string, t int, x double")
    assert {r.acf for r in acf(df, ["k"], "t", "x").collect()} == {None}


def test_fewer_lags_on_request(spark):
    df = spark.createDataFrame([("c", t, float(t % 3)) for t in range(1, 9)], "k string, t int, x double")
    assert sorted(r.lag for r in acf(df, ["k"], "t", "x", max_lag=3).collect()) == [0, 1, 2, 3]
