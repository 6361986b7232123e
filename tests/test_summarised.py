"""Template formatting and name/level splitting."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataflow.operators.summarised import format_estimates, split_all, split_name_level

SCHEMA = "id long, g string, estimate_name string, estimate_type string, estimate_value string"


def _rows(spark, cells):
    return spark.createDataFrame(
        [(i, g, n, "numeric", v) for i, (g, n, v) in enumerate(cells, start=1)], SCHEMA
    )


def _shown(df):
    return sorted((r.g, r.estimate_name, r.estimate_value) for r in df.collect())


def test_a_template_takes_its_keys_from_later_ones(spark):
    df = _rows(spark, [("a", "n", "1"), ("a", "p", "50"), ("b", "n", "2")])
    out = format_estimates(df, ["<n> (<p>%)", "<n>"], order="id")
    assert _shown(out) == [("a", "n (p%)", "1 (50%)"), ("b", "n", "2")]


def test_incomplete_groups_stay_or_go(spark):
    df = _rows(spark, [("a", "min", "1"), ("a", "max", "9"), ("b", "min", "1"), ("b", "x", "7")])
    kept = format_estimates(df, {"Range": "<min>-<max>"}, order="id")
    assert _shown(kept) == [("a", "Range", "1-9"), ("b", "min", "1"), ("b", "x", "7")]
    assert _shown(format_estimates(df.drop("id"), {"Range": "<min>-<max>"}, keep_unformatted=False)) == [("a", "Range", "1-9")]


def test_missing_value_gives_missing_text(spark):
    df = _rows(spark, [("a", "min", None), ("a", "max", "9")])
    assert _shown(format_estimates(df.drop("id"), ["<min>-<max>"])) == [("a", "min-max", None)]


def test_duplicate_estimates_are_not_formatted(spark):
    df = _rows(spark, [("a", "min", "1"), ("a", "min", "2"), ("a", "max", "9")])
    assert len(_shown(format_estimates(df.drop("id"), ["<min>-<max>"]))) == 3
    # Three rows for three keys, but one of the keys is absent from the group.
    more = df.union(_rows(spark, [("b", "mean", "5")]))
    assert len(_shown(format_estimates(more.drop("id"), ["<mean> <min> <max>"]))) == 4


def test_unknown_and_keyless_templates_warn_and_change_nothing(spark):
    df = _rows(spark, [("a", "n", "1")])
    with pytest.warns(UserWarning, match="keys the data lacks"):
        assert _shown(format_estimates(df.drop("id"), ["<median>"])) == [("a", "n", "1")]
    with pytest.warns(UserWarning, match="without a <key>"):
        assert _shown(format_estimates(df.drop("id"), ["plain"])) == [("a", "n", "1")]
    assert format_estimates(df, None) is df


def test_a_formatted_row_can_be_taken_by_a_later_template_of_its_name(spark):
    df = _rows(spark, [("a", "min", "1"), ("a", "max", "9"), ("a", "mean", "5")])
    out = format_estimates(df.drop("id"), {"mean": "<min>-<max>", "centre": "<mean>"})
    assert _shown(out) == [("a", "centre", "5")]


def test_order_columns_sort_by_group_then_template_then_appearance(spark):
    cells = [("b", "x", "1"), ("b", "n", "2"), ("a", "n", "3"), ("a", "w", "4"), ("a", "x", "5")]
    out = format_estimates(_rows(spark, cells), {"N": "<n>"}, order="id")
    ordered = out.orderBy("group_id", "format_id", "name_first_id").collect()
    assert [(r.g, r.estimate_name) for r in ordered] == [("b", "N"), ("b", "x"), ("a", "N"), ("a", "x"), ("a", "w")]


def test_split_places_values_by_position_and_fills(spark):
    df = spark.createDataFrame(
        [(1, "age &&& sex", "10 &&& F", 9), (2, "overall", "overall", 9), (3, "sex and age", "M and 20", 9)],
        "i int, n string, l string, z int",
    )
    out = split_name_level(df, "n", "l")
    assert out.columns == ["i", "age", "sex", "z"]
    assert sorted(map(tuple, out.collect())) == [(1, "10", "F", 9), (2, "overall", "overall", 9), (3, "20", "M", 9)]
    kept = split_name_level(df, "n", "l", keep=True, fill=None)
    assert kept.columns == ["i", "n", "l", "age", "sex", "z"]
    assert kept.filter("i = 2").collect()[0].age is None


@pytest.mark.parametrize("columns", [None, ["a", "b"], []])
def test_unequal_lengths_fail(spark, columns):
    df = spark.createDataFrame([("a and b", "only one")], "n string, l string")
    with pytest.raises(Exception, match="different numbers of parts"):
        split_name_level(df, "n", "l", columns=columns).collect()


def test_overwritten_columns_warn(spark):
    df = spark.createDataFrame([("x", "1", "old")], "n string, l string, x string")
    with pytest.warns(UserWarning, match="columns replaced"):
        out = split_name_level(df, "n", "l")
    assert out.collect()[0].x == "1"


def test_parts_that_were_not_asked_for_fail(spark):
    df = spark.createDataFrame([("age &&& region", "old &&& north")], "n string, l string")
    with pytest.raises(Exception, match="not asked for"):
        split_name_level(df, "n", "l", columns=["age"]).collect()


def test_columns_clash_whatever_their_case(spark):
    df = spark.createDataFrame([("Sex", "Both", "old")], "n string, l string, sex string")
    with pytest.warns(UserWarning, match="columns replaced"):
        out = split_name_level(df, "n", "l")
    assert out.columns == ["Sex"] and out.collect()[0].Sex == "Both"


def test_a_narrower_separator(spark):
    df = spark.createDataFrame([("reason", "Sex: Both and age known")], "n string, l string")
    assert split_name_level(df, "n", "l", separator=" &&& ").collect()[0].reason == "Sex: Both and age known"


def test_split_all_without_strata(spark):
    df = spark.createDataFrame(
        [("c", "x", "overall", "overall", "overall", "overall")],
        "group_name string, group_level string, strata_name string, strata_level string, "
        "additional_name string, additional_level string",
    )
    assert split_all(df).columns == ["c"]


word = st.text(alphabet="abcdefg", min_size=1, max_size=4)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(word, word, min_size=1, max_size=4), min_size=1, max_size=8))
def test_splitting_undoes_joining(spark, records):
    rows = [(i, " &&& ".join(r), " &&& ".join(r.values())) for i, r in enumerate(records)]
    out = split_name_level(spark.createDataFrame(rows, "i int, n string, l string"), "n", "l", fill=None)
    for row in out.collect():
        found = {k: v for k, v in row.asDict().items() if k != "i" and v is not None}
        assert found == records[row.i]


def test_formatting_never_loses_or_invents_groups(spark):
    cells = [(f"g{i % 7}", n, str(i)) for i, n in enumerate(["n", "p", "min", "max", "mean"] * 7)]
    df = _rows(spark, cells)
    out = format_estimates(df.drop("id"), ["<n> (<p>%)", "<mean> (<min> to <max>)"])
    assert {r.g for r in out.select("g").distinct().collect()} == {f"g{i}" for i in range(7)}
    assert out.filter(F.col("estimate_name") == "n (p%)").count() == 7
