"""Plans: what moves, how often, and what happens when one key holds a third of the rows."""

import re

import pytest
from pyspark.sql import functions as F

from strataflow.operators import aggregates, joins, windows
from strataflow.operators.summarised import format_estimates, split_all
from strataflow.plans import correlation, regression, series
from strataflow.plans.series import SERIES, STRATUM
from strataflow.sources.bucketed import read_bucketed, write_bucketed

SCHEMA = (
    "database_name string, outcome_cohort_name string, denominator_age_group string, denominator_sex string, "
    "analysis_interval string, incidence_start_date date, n_events double, person_years double, unused string"
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange hashpartitioning", plan_of(df)))


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "t")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def test_series_take_one_exchange_for_the_rollup_and_one_for_all_windows(raw):
    df = series.sr_series_quarterly(raw, timepoints=["2020-03-01", "2020-04-01"])
    assert exchanges(df) == 2
    # The first one carries partial sums, not rows.
    assert "partial_sum" in plan_of(df)
    assert "unused" not in plan_of(df) and "EqualTo(analysis_interval,months)" in plan_of(df)


def test_fitting_and_correlating_add_no_exchange(raw):
    df = series.sr_series_quarterly(raw, timepoints=["2020-04-01"])
    fits = regression.fit_segmented(df)
    assert exchanges(fits) == 2
    assert exchanges(regression.predict_band(fits)) == 2
    assert exchanges(regression.residual_acf(fits)) == 2
    rates = df.withColumn("x", F.col("n_events_sum") / F.col("person_years_sum"))
    r = correlation.acf(rates, SERIES, "time", "x")
    assert exchanges(r) == 2 and exchanges(correlation.pacf(r, SERIES)) == 2


def test_stored_rollups_move_nothing(spark, tmp_path):
    rows = spark.range(4000).selectExpr(
        "concat('db', id % 5) as database_name", "concat('o', id % 3) as outcome_cohort_name",
        "if(id % 2 = 0, '0 to 150', null) as denominator_age_group", "'Both' as denominator_sex", "'months' as analysis_interval",
        "make_date(2018 + cast(id % 48 div 12 as int), 1 + cast(id % 12 as int), 1) as incidence_start_date",
        "cast(5 + id % 7 as double) as n_events", "100.0D + id % 11 as person_years",
    )
    at = ["2020-03-01", "2020-04-01"]
    for period, whole in (("quarter", series.sr_series_quarterly), ("month", series.sr_series_monthly)):
        path = str(tmp_path / f"it's {period}")
        series.write_rollup(rows, path, period=period, buckets=4)
        stored = series.series_from_rollup(read_bucketed(spark, path), timepoints=at)
        assert exchanges(stored) == 0
        assert sorted(map(str, stored.collect())) == sorted(map(str, whole(rows, timepoints=at).collect()))
    fits = regression.fit_segmented(stored)
    assert exchanges(fits) == 0 and exchanges(regression.residual_acf(fits)) == 0
    assert fits.count() == 3 * stored.select(*SERIES).distinct().count()
    # Every bucket is one file.
    assert len(list((tmp_path / "it's month" / "rows").glob("*.parquet"))) <= 4
    with pytest.raises(Exception, match="(?i)exist"):
        series.write_rollup(rows, path, period="month", buckets=4)


def test_a_table_cut_short_cannot_be_read(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    failing = spark.range(10).selectExpr("id", "if(id = 7, raise_error('lost'), id) as v")
    with pytest.raises(Exception, match="lost"):
        write_bucketed(failing, str(tmp_path / "t"), ["id"], buckets=2)
    with pytest.raises(Exception):
        read_bucketed(spark, str(tmp_path / "t"))
    assert {t.name for t in spark.catalog.listTables()} == before


SUMMARISED = (
    "cdm_name string, group_name string, group_level string, strata_name string, strata_level string, variable_name string, "
    "variable_level string, estimate_name string, estimate_type string, estimate_value string, "
    "additional_name string, additional_level string"
)


def test_a_thousand_columns_take_one_exchange(spark):
    names = [f"db{k:04d}" for k in range(1000)]
    cells = spark.range(5000).select(
        (F.col("id") % 7).alias("i"),
        F.format_string("db%04d", F.col("id").cast("int") % 1000).alias("c"),
        F.when(F.col("id") % 11 != 0, F.col("id").cast("string")).alias("v"),
    ).dropDuplicates(["i", "c"])
    wide = aggregates.pivot_wide(cells, ["i"], "c", "v", names)
    rows = {r["i"]: r.asDict() for r in wide.collect()}
    assert wide.columns == ["i", *names] and len(rows) == 7
    for r in cells.collect():
        assert rows[r.i][r.c] == r.v
    stored = spark.createDataFrame([], "i long, c string, v string")
    assert exchanges(aggregates.pivot_wide(stored, ["i"], "c", "v", names)) == 1


def test_formatting_is_one_aggregation_and_splitting_none(spark):
    df = spark.createDataFrame([], SUMMARISED)
    out = format_estimates(df, ["<count>", "<mean> (<min> to <max>)"], keep_unformatted=False, known_names=["count", "mean", "min", "max"])
    assert exchanges(out) == 1
    parts = {"group": ["cohort_name"], "strata": ["age", "sex"], "additional": []}
    assert exchanges(split_all(df, columns=parts)) == 0
    wide = aggregates.pivot_database(df, ["group_level", "variable_name"], "cdm_name", "estimate_value", ["a", "b"])
    assert exchanges(wide) == 1


def test_a_hot_key_is_split_when_group_stats_are_joined_back(spark):
    """With both sides too big to broadcast, adaptive execution splits the hot group's rows."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.range(0, 300_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("k"),
            F.col("id").alias("row"),
            F.sha2(F.col("id").cast("string"), 256).alias("load"),
        )
        out = windows.group_min_id(df, ["k"], "row")
        got = out.agg(F.count("*").alias("n"), F.sum("group_id").alias("s")).collect()[0]
        counted = out.groupBy("k").agg(F.count("*").alias("n"), F.max("group_id").alias("g"))
        assert got.n == 300_000
        assert counted.filter("k = 'hot'").collect()[0].n == 100_000
        rows = out.select("k", "group_id", "load")
        rows.collect()
        assert "skew=true" in plan_of(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_rollup_sends_partial_sums_of_a_hot_series(spark):
    rows = spark.range(0, 200_000, 1, 8).select(
        *[F.lit("one").alias(c) for c in STRATUM],
        F.lit("months").alias("analysis_interval"),
        F.date_add(F.lit("2015-01-01").cast("date"), (F.col("id") % 2000).cast("int")).alias("incidence_start_date"),
        F.lit(1.0).alias("n_events"),
        F.lit(2.0).alias("person_years"),
    )
    out = series.sr_series_monthly(rows, timepoints=["2018-04-01"])
    assert out.count() == 65  # 66 calendar months, less the timepoint's own
    total = aggregates.monthly_rollup(rows, STRATUM).agg(F.sum("n_events_sum")).collect()[0][0]
    assert total == 200_000.0


def test_unknown_sides_are_never_forced_into_a_broadcast(raw):
    stats = joins.with_group_stats(raw, ["database_name"], {"m": F.max("n_events")})
    logical = stats._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in logical.lower() and "ResolvedHint" not in logical


def test_written_sides_spare_the_shuffle_of_a_stored_table(spark, tmp_path):
    from strataflow.plans.covariates import index_overlay
    from strataflow.sources.dims import mapping_table

    rates = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("database_name"),
        *[F.lit("x").alias(c) for c in STRATUM[1:]],
        F.add_months(F.lit("2019-01-01").cast("date"), (F.col("id") / 3).cast("int")).alias("incidence_start_date"),
        *[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(("incidence", "incidence_95CI_lower", "incidence_95CI_upper"))],
    )
    rates.write.parquet(str(tmp_path / "rates"))
    stored = spark.read.parquet(str(tmp_path / "rates"))
    index = spark.range(900).select(
        F.lit("land").alias("country"),
        F.date_add(F.lit("2019-06-01").cast("date"), F.col("id").cast("int")).alias("date"),
        (F.col("id") % 50).cast("double").alias("si"),
    )
    dim = mapping_table(spark, {"A": "land"}, "database", "country")
    lazy, written = (index_overlay(stored, index, dim, written=w) for w in (False, True))
    assert exchanges(written) == 0 and "BroadcastHashJoin" in plan_of(written)
    assert exchanges(lazy) > 0
    assert lazy.count() == 600 and lazy.exceptAll(written).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_few_groups_of_a_stored_table_are_written_first(spark, tmp_path, broadcast):
    from strataflow.operators.sets import template_order

    rows = spark.range(600).select(
        F.concat(F.lit("n"), F.col("id") % 5).alias("estimate_name"),
        F.date_add(F.lit("2019-01-01").cast("date"), (F.col("id") / 5).cast("int")).alias("d"),
        F.col("id").alias("row"),
    )
    rows.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        if not broadcast:
            for k in limits:
                spark.conf.set(k, "-1")
        for f in (
            lambda w: template_order(stored, ["n3", "n1"], "row", written=w),
            lambda w: windows.drop_last_dates(stored, ["estimate_name"], "d", 5, written=w),
        ):
            lazy, written = f(False), f(True)
            # Broadcast: the table is not shuffled. Without: its rows once, by the key.
            assert exchanges(written) == (0 if broadcast else 2)
            assert lazy.exceptAll(written).count() == 0 and lazy.count() == written.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_forecast_plot_data_computes_a_series_once_and_joins_nothing(raw):
    rates = raw.withColumns({c: F.col("n_events") for c in ("incidence", "incidence_95CI_lower", "incidence_95CI_upper")})
    modelled = series.sr_series_quarterly(raw, timepoints=["2020-04-01"])
    out = regression.forecast_plot_data(modelled, series.raw_rate_series(rates, ["2020-04-01"]))
    assert exchanges(out) == 3 and "Join" not in plan_of(out)


def test_unformatted_rows_come_by_one_join_on_the_groups(spark):
    df = spark.createDataFrame([], SUMMARISED)
    out = format_estimates(df, ["<count>", "<mean> (<min> to <max>)"], known_names=["count", "mean", "min", "max"])
    assert plan_of(out).count("Join") <= 1 and "Generate explode" not in plan_of(out)
