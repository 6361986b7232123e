"""Missing-value, rounding and text rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataflow.functions import missing, numbers, text
from strataflow.operators import aggregates, filters, joins, projections, sets, windows


def test_strict_sum_and_mean_are_null_when_any_input_is(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 2.0)], "k string, x double")
    out = {
        r.k: (r.s, r.m)
        for r in df.groupBy("k").agg(missing.strict_sum("x").alias("s"), missing.strict_avg("x").alias("m")).collect()
    }
    assert out == {"a": (None, None), "b": (3.0, 1.5)}


def test_joins_match_null_with_null(spark):
    left = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    right = spark.createDataFrame([(None, "none"), ("x", "ex"), ("x", "ex2")], "kk string, a string")
    out = joins.left_join_attributes(left, right, "k", "kk").collect()
    assert sorted((r.v, r.a) for r in out) == [(1, "none"), (2, "ex"), (2, "ex2")]
    assert joins.null_safe_anti_join(left, left.filter("k is null"), ["k"]).collect()[0].v == 2


def test_regex_on_null_does_not_match_and_keeps_the_row(spark):
    df = spark.createDataFrame([(None,), ("Sex",)], "v string")
    assert df.filter(~missing.matches("v", "Sex")).count() == 1


def test_quality_cutoff_drops_matching_name_without_date(spark):
    rows = [("THINX", None), ("THINX", dt.date(2023, 1, 1)), ("THINX", dt.date(2023, 1, 2)), (None, dt.date(2024, 1, 1)), ("Y", None)]
    df = spark.createDataFrame(rows, "n string, d date")
    out = filters.quality_cutoff(df, "n", "THIN", "d", "2023-01-01").collect()
    assert {(r.n, r.d) for r in out} == {("THINX", dt.date(2023, 1, 1)), (None, dt.date(2024, 1, 1)), ("Y", None)}


def test_membership_is_never_null_and_empty_matches_nothing(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert df.filter(missing.in_set("v", [])).count() == 0
    assert df.filter(~missing.in_set("v", ["a"])).count() == 1
    assert df.filter(missing.in_set("v", [None])).count() == 1


def test_dates_are_compared_as_dates_so_the_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2020, 2, 1),)], "incidence_start_date date")
    df.write.parquet(str(tmp_path / "t"))
    out = filters.multi_filter(spark.read.parquet(str(tmp_path / "t")), {"incidence_start_date": ["2020-02-01"]})
    assert out.count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(incidence_start_date" in plan or "EqualTo(incidence_start_date" in plan


def test_united_key_shows_null_as_na(spark):
    df = spark.createDataFrame([("a", None)], "x string, y int")
    assert projections.unite_key(df, "k", ["x", "y"]).collect()[0].k == "a; NA"


def test_rounding_is_half_even_and_bad_numbers_are_null(spark):
    df = spark.createDataFrame([("0.125",), ("abc",), (None,)], "v string")
    out = [r.r for r in df.select(numbers.half_even(numbers.safe_cast("v", "double"), 2).alias("r")).collect()]
    assert out == [0.12, None, None]


@pytest.mark.parametrize(
    "value,expected", [(100000.0, "100000"), (12.5, "12.5"), (0.001, "0"), (1234567.891, "1234567.89"), (-2.0, "-2")]
)
def test_plain_number_has_no_exponent_nor_trailing_zeros(spark, value, expected):
    assert spark.range(1).select(numbers.plain_number(F.lit(value), 2).alias("v")).collect()[0].v == expected


def test_display_numbers(spark):
    df = spark.createDataFrame([(1234567.891,), (None,)], "x double")
    out = df.select(
        numbers.grouped_number("x", 0).alias("a"), numbers.grouped_number("x", 2, "NA").alias("b")
    ).collect()
    assert [tuple(r) for r in out] == [("1,234,567", "1,234,567.89"), (None, "NA")]


def test_first_rule_wins(spark):
    df = spark.createDataFrame([("x/tar30/a.csv",), ("x/tar365/a.csv",), ("x/a.csv",), (None,)], "p string")
    out = projections.path_tag(df, "p", [("tar30", "30"), ("tar365", "365")], "Inf")
    assert [r.time_at_risk for r in out.collect()] == ["30", "365", "Inf", "Inf"]


def test_label_recode_passes_unknown_codes_and_keeps_order(spark):
    df = spark.createDataFrame([("ibd",), ("unknown",), (None,)], "o string")
    out = projections.label_recode(df, "o", {"ibd": "Bowel"}, "s").collect()
    assert [(r.o, r.s) for r in out] == [("Bowel", "ibd"), ("unknown", "unknown"), (None, None)]


def test_columns_can_be_relocated(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert projections.relocate_columns(df, ["d"]).columns == ["d", "a", "b", "c"]
    assert projections.relocate_columns(df, ["a"], after="c").columns == ["b", "c", "a", "d"]
    assert projections.relocate_columns(df, ["c", "d"], before="b").columns == ["a", "c", "d", "b"]
    with pytest.raises(ValueError):
        projections.drop_constant_settings(df, ["a", "zz"])


def test_ragged_union_fills_null(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2.0)], "s string, d double")
    out = sets.ragged_union([a, b])
    assert out.columns == ["i", "s", "d"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "x", None), (None, "y", 2.0)]


def test_template_order_follows_first_appearance(spark):
    rows = [(1, "z"), (2, "b"), (3, "t1"), (4, "b"), (5, "a")]
    df = spark.createDataFrame(rows, "id int, estimate_name string")
    out = sets.template_order(df, ["t1", "t2"], "id")
    ordered = out.orderBy("format_id", "name_first_id", "id").collect()
    assert [r.id for r in ordered] == [3, 1, 2, 4, 5]


def test_rolling_mean_needs_all_points(spark):
    rows = [("a", dt.date(2020, m, 1), float(m), 1.0 if m != 4 else None) for m in range(1, 9)]
    df = spark.createDataFrame(rows, "k string, d date, x double, y double")
    out = windows.rolling_mean_5(df, ["k"], "d", ["x", "y"]).orderBy("d").collect()
    assert [r.x for r in out] == [3.0, 4.0, 5.0, 6.0]
    assert [r.y for r in out] == [None, None, None, None]


def test_drop_last_dates_counts_distinct_dates(spark):
    rows = [("a", dt.date(2020, m, 1), i) for m in range(1, 8) for i in range(2)] + [("b", dt.date(2020, 1, 1), 0)]
    df = spark.createDataFrame(rows, "k string, d date, i int")
    out = windows.drop_last_dates(df, ["k"], "d", 5).collect()
    assert sorted({(r.k, r.d.month) for r in out}) == [("a", 1), ("a", 2)] and len(out) == 4


def test_max_and_first_place_it_is_attained(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 2), ("a", 5.0, 1), ("b", None, 1)], "k string, v double, t int")
    out = {r.k: (r.max_v, r.t_at_max) for r in aggregates.max_and_argmax(df, "v", "t", ["k"]).collect()}
    assert out == {"a": (5.0, 1), "b": (None, None)}


def test_pivot_fails_on_two_rows_for_one_cell(spark):
    df = spark.createDataFrame([("i", "x", 1), ("i", "x", 2)], "id string, c string, v int")
    with pytest.raises(Exception, match="more than one row"):
        aggregates.pivot_wide(df, ["id"], "c", "v", ["x"]).collect()


def test_pivot_fails_on_a_value_without_a_column(spark):
    df = spark.createDataFrame([("i", "A", 1), ("i", "B", 2)], "id string, c string, v int")
    with pytest.raises(Exception, match="no column was asked for c B"):
        aggregates.pivot_wide(df, ["id"], "c", "v", ["A"]).collect()
    assert aggregates.pivot_wide(df.filter("c = 'A'"), ["id"], "c", "v", ["A"]).collect()[0].A == 1


def test_null_is_a_column_of_the_pivot_or_fails(spark):
    rows = [(1, "A", "x"), (1, None, "kept"), (2, None, "too"), (None, "A", None)]
    df = spark.createDataFrame(rows, "id int, c string, v string")
    wide = aggregates.pivot_wide(df, ["id"], "c", "v")
    assert wide.columns == ["id", "A", "NA"]
    assert {tuple(r) for r in wide.collect()} == {(1, "x", "kept"), (2, None, "too"), (None, None, None)}
    with pytest.raises(Exception, match="no column was asked for c NULL"):
        aggregates.pivot_wide(df, ["id"], "c", "v", ["A"]).collect()
    assert aggregates.pivot_wide(df, ["id"], "c", "v", [None, "A"]).columns == ["id", "NA", "A"]
    with pytest.raises(ValueError, match="NA"):
        aggregates.pivot_wide(df.unionByName(spark.createDataFrame([(3, "NA", "y")], df.schema)), ["id"], "c", "v")
    with pytest.raises(Exception, match="more than one row for a cell of column NA"):
        aggregates.pivot_wide(df.unionByName(df), ["id"], "c", "v", [None, "A"]).filter("id = 2").collect()


def test_pivots_of_nothing(spark):
    df = spark.createDataFrame([], "id int, c string, v int")
    assert aggregates.pivot_wide(df, ["id"], "c", "v").columns == ["id"]
    assert aggregates.pivot_wide(df, ["id"], "c", "v").count() == 0
    assert aggregates.pivot_wide(df, ["id"], "c", "v", ["x", "y"]).columns == ["id", "x", "y"]
    one = spark.createDataFrame([(1, 7, 1.5), (2, 9, 2.5)], "id int, c int, v double")
    assert aggregates.pivot_wide(one, [], "c", "v").collect() == [(1.5, 2.5)]
    with pytest.raises(Exception, match="no column was asked for c 7"):
        aggregates.pivot_wide(one.limit(1), ["id"], "c", "v", []).collect()


def test_table_one_of_nothing(spark):
    from strataflow.plans.table_one import table_one
    from strataflow.sources import schemas

    cohorts = spark.createDataFrame([], "denominator_cohort_name string, denominator_sex string, denominator_age_group string")
    empty = spark.createDataFrame([], schemas.SUMMARISED_RESULT)
    out = table_one(empty.withColumn("result_id", F.lit(1)), cohorts)
    assert out.count() == 0 and {"Outcome", "Variable", "Sex", "Age group"} <= set(out.columns)
    assert "A" in table_one(empty.withColumn("result_id", F.lit(1)), cohorts, databases=["A"]).columns


def test_flags_negate_only_when_told(spark):
    df = spark.createDataFrame([("tracked",), (None,)], "t string")
    out = projections.regex_flags(df, "t", {"not_tracked": "tracked", "other": ("tracked", True)}).collect()
    assert [(r.not_tracked, r.other) for r in out] == [(True, False), (False, True)]


def test_large_and_small_numbers_as_plain_text(spark):
    df = spark.createDataFrame([(12345678.0, 1.5e-5, "1E7"), (0.1, -3e20, None)], "a double, b double, c string")
    out = projections.unite_key(df, "k", ["a", "b", "c"]).select("k").collect()
    assert [r.k for r in out] == ["12345678.0; 0.000015; 1E7", "0.1; -300000000000000000000.0; NA"]
    shown = df.select(text.render_template("<a>|<b>", {"a": "a", "b": "b"}).alias("t")).collect()
    assert [r.t for r in shown] == ["12345678.0|0.000015", "0.1|-300000000000000000000.0"]
    assert {(r.column, r.value) for r in aggregates.facet_domains(df, ["a"]).collect()} == {("a", "12345678.0"), ("a", "0.1")}


def test_plain_number_keeps_what_has_too_many_digits(spark):
    df = spark.createDataFrame([(2.5e36,), (2.675,), (1e7,)], "v double")
    assert [r.t for r in df.select(numbers.plain_number("v", 2).alias("t")).collect()] == ["2.5E36", "2.68", "10000000"]


def test_scale_to_max_with_zero_index(spark):
    df = spark.createDataFrame([("a", 2.0, 10.0), ("a", 4.0, 5.0), ("b", 0.0, 5.0)], "k string, si double, x double")
    out = {(r.k, r.x): r.si for r in joins.scale_to_max(df, "si", "x", ["k"]).collect()}
    assert out == {("a", 10.0): 5.0, ("a", 5.0): 10.0, ("b", 5.0): None}


def test_template_text():
    assert text.template_key_list("<mean> (<min> to <max>)") == ["mean", "min", "max"]
    assert text.template_name("<mean> (<min> to <max>)") == "mean (min to max)"


def test_render_template_is_null_when_a_slot_is(spark):
    df = spark.createDataFrame([("1", "2"), ("1", None)], "a string, b string")
    out = [r.t for r in df.select(text.render_template("<a>, b=<b>!", {"a": "a", "b": "b"}).alias("t")).collect()]
    assert out == ["1, b=2!", None]
