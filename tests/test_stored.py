"""The choice of plan for tables that are read again cheaply."""

import pytest
from pyspark.sql import functions as F
from test_plans import exchanges

from strataflow.operators import joins, sets, windows
from strataflow.sources import stored
from strataflow.sources.commits import publish, published


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = spark.range(900).select(
        F.concat(F.lit("n"), F.col("id") % 5).alias("estimate_name"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"),
        F.date_add(F.lit("2019-01-01").cast("date"), (F.col("id") / 5).cast("int")).alias("d"),
        F.col("id").alias("row"),
        (F.col("id") % 50).cast("double").alias("v"),
    )
    path = str(tmp_path_factory.mktemp("stored") / "t")
    rows.write.parquet(path)
    return spark.read.parquet(path)


CHOICES = {
    "template_order": lambda t, w: sets.template_order(t, ["n3"], "row", written=w),
    "drop_last_dates": lambda t, w: windows.drop_last_dates(t, ["estimate_name", "g"], "d", 5, written=w),
    "group_min_id": lambda t, w: windows.group_min_id(t, ["g"], "row", written=w),
    "complete_groups": lambda t, w: windows.complete_groups(t, ["g", "d"], ["n1", "n2"], written=w),
    "scale_to_max": lambda t, w: joins.scale_to_max(t, "v", "row", ["g"], written=w),
}


@pytest.mark.parametrize("name", CHOICES)
def test_few_keys_of_a_stored_table_move_nothing(table, name):
    lazy, chosen = CHOICES[name](table, False), CHOICES[name](table, None)
    assert exchanges(chosen) == 0 < exchanges(lazy)
    assert lazy.count() == chosen.count() and lazy.exceptAll(chosen).count() == 0


def test_many_keys_and_computed_tables_keep_one_plan(spark, table):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "4k")
        assert not stored.few_keys(table, ["row"]) and stored.few_keys(table, ["g"])
        assert exchanges(windows.group_min_id(table, ["row"], "v")) > 0
        spark.conf.set(limit, "-1")
        assert not stored.few_keys(table, ["g"])
    finally:
        spark.conf.set(limit, before)
    assert stored.few_keys(table.limit(0), ["g"])
    computed = table.groupBy("g", "estimate_name").agg(F.max("row").alias("row"))
    assert exchanges(windows.group_min_id(computed, ["g"], "row")) > 0


def test_what_counts_as_stored(spark, table, tmp_path):
    root = str(tmp_path / "lake")
    publish(spark, root, {"t": table})
    publish(spark, root, {"t": table.drop("v")}, append=["t"])
    assert stored.is_stored(table) and stored.is_stored(published(spark, root)["t"])
    assert stored.is_stored(table.filter("g = 1").withColumn("w", F.col("v") + 1).drop("d"))
    for df in (spark.range(3), table.distinct(), table.join(table.select("g").distinct(), "g"), table.limit(3)):
        assert not stored.is_stored(df)


def test_sizes_are_read_as_spark_spells_them():
    assert [stored.byte_size(t) for t in ("10485760b", "10MB", "64k", "1gb", "-1", "7")] == [
        10485760, 10 << 20, 64 << 10, 1 << 30, -1, 7
    ]
    with pytest.raises(ValueError):
        stored.byte_size("many")
