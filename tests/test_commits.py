"""Versions of a lake, and loads of new files only."""

import os

import pytest
from pyspark.sql import functions as F

from strataflow.plans.lake import load_new, load_results
from strataflow.sources.commits import publish, published, versions

ATTRITION = "cdm_name,outcome_cohort_name,reason_id,reason,number_records\n"


def rows(df):
    return sorted(map(repr, df.collect()))


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def estimates(db, extra="", cohort="c1", value="1.5"):
    names = (
        "cdm_name,analysis_interval,incidence_start_date,outcome_cohort_name,denominator_cohort_name,"
        "denominator_sex,denominator_age_group,incidence_100000_pys"
    )
    own = f"{db},months,2022-02-01,asthma,{cohort},Both,0 to 150,{value}"
    return f"{names}{',' + extra if extra else ''}\n{own}{',x' if extra else ''}\n"


def test_a_second_load_reads_the_added_file_only(spark, tmp_path):
    source, root = tmp_path / "My [DB] 50%", str(tmp_path / "la{k}e")
    first = put(source / "a" / "Incidence_attrition.csv", ATTRITION + "A,o,1,all,10\n")
    assert load_new(spark, str(source), root) == 1
    old = os.stat(first)
    first.write_text("#" * old.st_size)  # as large and old as before: reading it again would fail
    os.utime(first, ns=(old.st_atime_ns, old.st_mtime_ns))
    put(source / "b" / "Incidence_attrition.csv", ATTRITION + "B,o,1,all,20\n")
    assert load_new(spark, str(source), root) == 2
    assert load_new(spark, str(source), root) == 2
    got = published(spark, root)
    assert {(r.cdm_name, r.number_records) for r in got["incidence_attrition"].collect()} == {("A", 10), ("B", 20)}
    assert got["loaded_files"].count() == 2 and versions(spark, root) == [1, 2]
    assert published(spark, root, 1)["incidence_attrition"].count() == 1


def test_loads_add_up_to_a_full_load(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "lake")
    files = {
        "a/Incidence_tar30.csv": estimates("A"),
        "a/snapshot.csv": "cdm_name,cdm_version,person_cnt\nA,5.3,12\n",
        "b/Incidence_tar365.csv": estimates("B", "more"),  # a column of its own, the cohort of A
        "c/Incidence_tar30.csv": estimates("C", cohort="c2"),
        "c/empty_Incidence.csv": "",
        "c/notes.txt": "no result",
    }
    for i, (name, text) in enumerate(files.items()):
        put(source / name, text)
        load_new(spark, str(source), root)
        if i == 0:
            assert set(published(spark, root)) == {"incidence_estimates", "denominator_cohorts", "loaded_files"}
    whole, got = load_results(spark, str(source)), published(spark, root)
    assert set(got) == {*whole, "loaded_files"}
    for name, df in whole.items():
        assert set(got[name].columns) == set(df.columns)
        assert rows(got[name].select(*df.columns)) == rows(df), name
    assert got["denominator_cohorts"].count() == 2
    again = published(spark, root)["incidence_estimates"].filter("database_name = 'A'")
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(database_name" in plan and again.count() == 1


def test_a_changed_file_fails_by_name_and_a_folder_without_results_gives_nothing(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "lake")
    put(source / "notes.txt", "none")
    assert load_new(spark, str(source), root) == 0 and published(spark, root) == {}
    path = put(source / "Incidence_attrition.csv", ATTRITION + "A,o,1,all,10\n")
    load_new(spark, str(source), root)
    path.write_text(ATTRITION + "A,o,1,all,100\n")
    with pytest.raises(ValueError, match="Incidence_attrition.csv"):
        load_new(spark, str(source), root)
    assert published(spark, root)["incidence_attrition"].first().number_records == 10


def test_a_failed_write_leaves_the_old_version_whole(spark, tmp_path):
    root = str(tmp_path / "lake")
    names = ["one", "two", "three"]
    publish(spark, root, {n: spark.range(5).withColumn("n", F.lit(n)) for n in names})
    new = {n: spark.range(9).withColumn("n", F.lit(n)) for n in names}
    new["three"] = new["three"].withColumn("n", F.when(F.col("id") > 7, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        publish(spark, root, new)
    assert versions(spark, root) == [1]
    assert [df.count() for df in published(spark, root).values()] == [5, 5, 5]
    held = published(spark, root)["one"]
    assert publish(spark, root, {"one": spark.range(2)}) == 2
    assert publish(spark, root, {"one": spark.range(3)}, append=["one"]) == 3
    now = published(spark, root)
    assert (now["one"].count(), now["two"].count(), held.count()) == (5, 5, 5)
    assert publish(spark, root, {"one": now["one"]}, whole=True) == 4
    assert set(published(spark, root)) == {"one"} and published(spark, root)["one"].count() == 5


def test_loads_of_other_columns_empty_loads_and_null_folders(spark, tmp_path):
    root = str(tmp_path / "lake")
    layout = {"t": ["k"]}
    a = spark.createDataFrame([("x", 1), (None, 2), ("a/b=c", 3)], "k string, v int")
    b = spark.createDataFrame([("x", 1.5, 4)], "k string, w double, __load int")
    publish(spark, root, {"t": a}, layout=layout)
    publish(spark, root, {"t": a.limit(0)}, ["t"], layout)
    publish(spark, root, {"t": b.drop("__load")}, ["t"], layout)
    got = published(spark, root)["t"]
    assert sorted(map(repr, map(tuple, got.select("k", "v", "w").collect()))) == sorted(
        map(repr, [("x", 1, None), (None, 2, None), ("a/b=c", 3, None), ("x", None, 1.5)])
    )
    with pytest.raises(ValueError, match="__load"):
        publish(spark, root, {"t": b}, ["t"], layout)
    with pytest.raises(ValueError, match="no tables"):
        publish(spark, root, {})
    with pytest.raises(ValueError, match="no version 9"):
        published(spark, root, 9)


def test_two_writers_of_a_version_are_told(spark, tmp_path):
    root = str(tmp_path / "lake")
    publish(spark, root, {"t": spark.range(1)})
    theirs = spark.createDataFrame([("t", "0" * 32, "{}")], "name string, load string, schema string")
    theirs.coalesce(1).write.json(f"{root}/commits/{1:012d}-{'0' * 32}")
    for act in (lambda: published(spark, root), lambda: publish(spark, root, {"t": spark.range(1)})):
        with pytest.raises(ValueError, match="committed twice"):
            act()
