"""Autocorrelation and partial autocorrelation of many series at once."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import as_col


def default_max_lag(n: Column) -> Column:
    """floor(10 * log10(n)), at most n - 1."""
    return F.least(F.floor(F.lit(10.0) * F.log10(n)), n - 1).cast("int")


def acf(
    df: DataFrame, keys: Sequence[str], t: str, x: str, max_lag: int | None = None
) -> DataFrame:
    """Autocorrelation of each series at lags 0, 1, ..., the last one set by its length.

    ``df`` has one row per series and calendar period, which bounds a series; it is gathered into
    one row in the order of ``t`` and correlated by array functions inside the plan. Where ``df`` is
    already partitioned by the series keys, as the output of the series windows is, nothing moves.
    """
    point = F.struct(as_col(t), as_col(x).cast("double").alias("__v"))
    packed = df.groupBy(*keys_of(keys)).agg(F.sort_array(F.collect_list(point)).alias("__points"))
    values = F.transform(as_col("__points"), lambda p: p["__v"])
    return acf_of_arrays(packed.select(*keys_of(keys), values.alias("__x")), keys, "__x", max_lag)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times: a transform over a one-element array.

    Neighbouring projections are merged by the optimizer, so an array kept in a column of its own
    would be computed again at each use inside a lambda.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def acf_of_arrays(
    df: DataFrame, keys: Sequence[str], values: str, max_lag: int | None = None
) -> DataFrame:
    """Autocorrelation of series that are arrays in time order."""

    def centred(x: Column) -> Column:
        return _let(_total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean))

    def products(d: Column) -> Column:
        n = F.size(d)
        last = default_max_lag(n) if max_lag is None else F.least(F.lit(max_lag), n - 1)
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda k: _total(
                F.zip_with(F.slice(d, F.lit(1), n - k), F.slice(d, k + 1, n - k), lambda a, b: a * b)
            ),
        )

    def ratios(s: Column) -> Column:
        # try_divide: a constant series has no correlation.
        return F.transform(s, lambda v: F.try_divide(v, F.element_at(s, 1)))

    correlation = _let(_let(_let(as_col(values), centred), products), ratios)
    return df.filter(F.size(as_col(values)) > 0).select(
        *keys_of(keys), F.posexplode(correlation).alias("lag", "acf")
    )


def keys_of(keys: Sequence[str]) -> list[Column]:
    return [as_col(k) for k in keys]


def pacf(acf_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial autocorrelation at lags 1, 2, ... by the Durbin-Levinson recursion.

    A series' correlations are gathered in one row: lags grow with the logarithm of its length, so
    that row is short. The recursion is an array fold inside the plan; no Python runs.
    """

    def dot(a: Column, b: Column) -> Column:
        return _total(F.zip_with(a, b, lambda u, v: u * v))

    def step(r: Column, state: Column, k: Column) -> Column:
        phi = state["phi"]
        earlier = F.slice(r, F.lit(1), k - 1)
        gain = F.try_divide(
            F.element_at(r, k) - dot(phi, F.reverse(earlier)), F.lit(1.0) - dot(phi, earlier)
        )

        def extended(g: Column) -> Column:
            shrunk = F.zip_with(phi, F.reverse(phi), lambda a, b: a - g * b)
            return F.struct(
                F.concat(shrunk, F.array(g)).alias("phi"),
                F.concat(state["out"], F.array(g)).alias("out"),
            )

        return _let(gain, extended)

    empty = F.array().cast("array<double>")

    def folded(r: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(r)),
            F.struct(empty.alias("phi"), empty.alias("out")),
            lambda state, k: step(r, state, k),
            lambda state: state["out"],
        )

    ordered = F.sort_array(F.collect_list(F.struct(as_col("lag"), as_col("acf"))))
    one_row = acf_df.filter(as_col("lag") > 0).groupBy(*keys_of(keys)).agg(ordered.alias("__p"))
    r = F.transform(as_col("__p"), lambda p: p["acf"])
    return one_row.select(*keys_of(keys), F.posexplode(_let(r, folded)).alias("__i", "pacf")).select(
        *keys_of(keys), (as_col("__i") + 1).alias("lag"), as_col("pacf")
    )
