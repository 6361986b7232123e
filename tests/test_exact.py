"""Sums that keep every bit, whatever the order."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.functions.exact import exact_sum
from strataflow.operators import aggregates
from strataflow.plans import series


def bits(x):
    return None if x is None else struct.pack(">d", x)


def total(spark, values, parts=3):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(parts).agg(exact_sum("v")).first()[0]


@pytest.mark.parametrize(
    "values",
    [
        [0.1] * 10,
        [1e15, 0.3, -1e15, 1e-9],
        [-0.1, 0.1, -1e-20],
        [-5.5, 2.25, -0.75],
        [2.0**51, 2.0**-52, -(2.0**51)],
        [1e-25, 3e-26],
        [-1e-10],
        [0.0, -0.0],
        [123456.789, None, -0.001],
    ],
)
def test_the_sum_is_the_rounded_true_one(spark, values):
    want = math.fsum(v for v in values if v is not None)
    assert total(spark, values) == pytest.approx(want, rel=3e-16, abs=1e-30)


def test_odd_numbers(spark):
    inf, nan = float("inf"), float("nan")
    assert total(spark, []) is None and total(spark, [None, None]) is None
    assert total(spark, [1.0, inf]) == inf and total(spark, [-inf, 1.0]) == -inf
    assert math.isnan(total(spark, [inf, -inf])) and math.isnan(total(spark, [nan, 1.0]))
    assert total(spark, [1e300, 1.0]) == 1e300 and total(spark, [2.0**52, 0.5, 0.5]) == 2.0**52 + 1


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(4)
    n = 30_000
    rows = [
        (f"db{k % 2}", "o", "all", "Both", "months", f"{2015 + k % 6}-{k % 12 + 1:02d}-01", float(a) if k % 13 else None, float(b))
        for k, (a, b) in enumerate(zip(rng.exponential(3, n), 10.0 ** rng.uniform(-9, 7, n)))
    ]
    schema = "database_name string, outcome_cohort_name string, denominator_age_group string, denominator_sex string, analysis_interval string, d string, n_events double, person_years double"
    return spark.createDataFrame(rows, schema).withColumn("incidence_start_date", F.col("d").cast("date")).cache()


def by_bits(df):
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return sorted(str(tuple(bits(r[c]) if c in doubles else r[c] for c in df.columns)) for r in df.collect())


@pytest.mark.parametrize("what", ["quarterly", "monthly", "country", "index", "series"])
def test_rollups_have_the_same_bits_after_any_repartitioning(raw, what):
    keys = list(series.STRATUM)
    run = {
        "quarterly": lambda df: aggregates.quarterly_rollup(df, keys),
        "monthly": lambda df: aggregates.monthly_rollup(df, keys),
        "country": lambda df: aggregates.monthly_sum_country(df, ["database_name"], "person_years"),
        "index": lambda df: aggregates.monthly_mean_index(df, ["database_name"], "incidence_start_date", "person_years"),
        "series": lambda df: series.sr_series_quarterly(df, timepoints=["2018-04-01"]),
    }[what]
    first, *others = [by_bits(run(raw.orderBy(F.rand(n)).repartition(n))) for n in (1, 7, 64)]
    assert first and all(o == first for o in others)


def test_plain_sums_do_depend_on_it(raw):
    """What the exact sum is for: the built-in one of the same rows changes."""
    plain = [raw.orderBy(F.rand(n)).repartition(n).agg(F.sum("person_years")).first()[0] for n in (1, 7, 64)]
    assert len(set(plain)) > 1


def test_whole_numbers_keep_their_type(spark):
    df = spark.createDataFrame([("a", 2**60), ("a", 3), ("b", None)], "k string, v long")
    out = aggregates.monthly_sum_country(df, ["k"], "v")
    assert dict(out.dtypes)["v"] == "bigint" and {tuple(r) for r in out.collect()} == {("a", 2**60 + 3), ("b", None)}
