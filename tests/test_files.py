"""Reading, classifying and writing result files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.plans.lake import load_results, monthly_cases, policy_index, write_silver
from strataflow.sources import files, schemas
from strataflow.sources.scratch import materialise, shared_folder

SCHEMA = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("v", T.DoubleType())]
)


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_columns_are_united_by_name_whatever_their_order(spark, tmp_path):
    a = _write(tmp_path / "a.csv", '"","name","n","v"\n"1","x",1,1.5\n"2",NA,NA,NA\n')
    b = _write(tmp_path / "b.csv", "v,name,n\n2.5,y,2\n3.5,,3\n")
    c = _write(tmp_path / "c.csv", "name,n\nz,4\n")
    out = files.read_results(spark, [a, b, c], SCHEMA)
    assert out.columns == ["name", "n", "v"]
    assert {tuple(r) for r in out.collect()} == {
        ("x", 1, 1.5), (None, None, None), ("y", 2, 2.5), (None, 3, 3.5), ("z", 4, None)
    }


def test_quotes_and_line_breaks_survive(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", then\nleave', 1, 2.0), ("a\\b", 2, 3.0)], SCHEMA)
    files.write_export(df, str(tmp_path / "q"))
    paths = [str(p) for p in (tmp_path / "q").glob("*.csv")]
    back = files.read_results(spark, paths, SCHEMA, multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_a_value_of_the_wrong_type_fails_instead_of_vanishing(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "name,n,v\nx,one,1.5\n")
    with pytest.raises(Exception, match="one"):
        files.read_results(spark, [a], SCHEMA).collect()


def test_undeclared_columns_pass_through_on_request(spark, tmp_path):
    a = _write(tmp_path / "a.csv", 'name,"odd, one",n\nx,o,1\n')
    b = _write(tmp_path / "b.csv", "\ufeffname,n\ny,2\n")
    assert files.read_results(spark, [a, b], SCHEMA).columns == ["name", "n", "v"]
    out = files.read_results(spark, [a, b], SCHEMA, extras=True)
    assert out.columns == ["name", "n", "v", "odd, one"]
    assert sorted(map(tuple, out.collect())) == [("x", 1, None, "o"), ("y", 2, None, None)]


def test_uniform_mode_fails_on_another_header(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "name,n,v\nx,1,1.5\n")
    b = _write(tmp_path / "b.csv", "v,n,name\n2.5,2,y\n")
    assert files.read_results(spark, [a], SCHEMA, ragged=False).count() == 1
    with pytest.raises(Exception):
        files.read_results(spark, [a, b], SCHEMA, ragged=False).collect()


def test_files_are_classified_by_path(spark, tmp_path):
    names = ["db1/snapshot.csv", "db1/Incidence_tar30.csv", "db1/Incidence_attrition.csv", "db1/tableOne.csv", "db1/attrition_infection.csv", "db1/notes.txt"]
    for n in names:
        _write(tmp_path / n, "x\n1\n")
    out = {r.path.rsplit("/", 1)[1]: r for r in files.classify_files(spark, str(tmp_path)).collect()}
    assert out["snapshot.csv"].snapshot and not out["snapshot.csv"].incidence_estimates
    assert out["Incidence_tar30.csv"].incidence_estimates and not out["Incidence_tar30.csv"].incidence_attrition
    assert out["Incidence_attrition.csv"].incidence_attrition and not out["Incidence_attrition.csv"].incidence_estimates
    assert out["tableOne.csv"].characterisation and out["attrition_infection.csv"].attrition_infection
    assert not any(out["notes.txt"][c] for c in files.FILE_CLASSES)


def test_an_export_reads_back_and_splits_a_hot_key(spark, tmp_path):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.when(F.col("id") % 5 != 0, F.col("id").cast("double") / 3).alias("x"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        files.write_export(df, str(tmp_path / "e"), ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = files.read_export(spark, str(tmp_path / "e"), df.schema)
    assert back.exceptAll(df).count() == 0 and back.count() == 4000
    assert len(list((tmp_path / "e" / "k=hot").glob("*.csv"))) > 1


def test_awkward_headers_and_dates(spark, tmp_path):
    path = _write(
        tmp_path / "covid_si.csv",
        'Entity,Code,Day,"Stringency index (weighted average)"\nFrance,FRA,2020-03-01,11.5\nSpain,ESP,2020-03-02,NA\nPeru,PER,2020-03-02,3\n',
    )
    out = policy_index(spark, path).collect()
    assert {tuple(r) for r in out} == {("France", dt.date(2020, 3, 1), 11.5), ("Spain", dt.date(2020, 3, 2), None)}
    with pytest.raises(ValueError, match="headers not found"):
        files.covariate_series(spark, path, {"Nope": "x"})


def test_monthly_cases_are_null_strict(spark, tmp_path):
    path = _write(
        tmp_path / "covid_cases.csv",
        "dateRep,month,year,cases,countriesAndTerritories\na,3,2020,5,Italy\nb,3,2020,7,Italy\nc,4,2020,NA,Italy\nd,4,2020,1,Italy\ne,4,2020,1,Peru\n",
    )
    out = {(r.month, r.country): r.cases for r in monthly_cases(spark, path).collect()}
    assert out == {(3, "Italy"): 12.0, (4, "Italy"): None}


INCIDENCE_HEADER = ",".join(["", *schemas.INCIDENCE_ESTIMATES.fieldNames()])


def _incidence_line(i, **values):
    cells = {"analysis_id": "1", "analysis_interval": "months", "cdm_name": "THINES", **values}
    return ",".join([str(i), *[str(cells.get(c, "NA")) for c in schemas.INCIDENCE_ESTIMATES.fieldNames()]])


def test_a_result_folder_becomes_tidy_tables(spark, tmp_path):
    alias = "The National Health Insurance Service?National Sample Cohort"
    lines = [
        _incidence_line(1, outcome_cohort_name="ibd", denominator_cohort_name="d1", incidence_start_date="2022-02-01", incidence_100000_pys="1.5"),
        _incidence_line(2, outcome_cohort_name="zzz", denominator_cohort_name="d2", incidence_start_date="2023-02-01"),
        _incidence_line(3, outcome_cohort_name="asthma", cdm_name=alias, denominator_cohort_name="d1", incidence_start_date="2023-02-01"),
    ]
    root = tmp_path / "data"
    _write(root / "x/Incidence_tar365.csv", "\n".join([INCIDENCE_HEADER, *lines]) + "\n")
    _write(root / "x/snapshot.csv", ",cdm_name,cdm_version,cdm_source_name,cdm_description,person_cnt\n1,THINES,5.3,s,d,12\n")
    out = load_results(spark, str(root))
    assert set(out) == {"snapshot", "incidence_estimates", "denominator_cohorts"}
    snapshot = out["snapshot"].collect()[0]
    assert (snapshot.cdm_version, snapshot.person_cnt) == ("5.3", "12")
    rows = {r.outcome_cohort_name: r for r in out["incidence_estimates"].collect()}
    # The poor-quality row is gone from the estimates, not from the cohort attributes.
    assert set(rows) == {"Iflammatory bowel disease", "Asthma"}
    assert out["denominator_cohorts"].count() == 2
    first = rows["Iflammatory bowel disease"]
    assert (first.time_at_risk, first.year_month, first.incidence, first.denominator_target_cohort_name) == (
        "365", "2022-02", 1.5, "all_population"
    )
    assert rows["Asthma"].database_name == "YUHS"
    write_silver(out, str(tmp_path / "silver"))
    silver = spark.read.parquet(str(tmp_path / "silver" / "incidence_estimates"))
    plan = silver.filter("database_name = 'YUHS'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(database_name" in plan and silver.count() == 2


def test_scratch_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "t"), shared_folder(spark, "t")
    assert first.startswith(root + "/t-") and first != second
    assert materialise(spark.range(3).withColumn("s", F.lit("x")), "t").count() == 3


ODD_NAMES = ["My DB", "50% [v1]", "a?b {x,y}", "plus+sign*"]


@pytest.mark.parametrize("name", ODD_NAMES)
def test_paths_with_blanks_and_pattern_characters(spark, tmp_path, name):
    a = _write(tmp_path / name / "Incidence x.csv", "name,n,v\nx,1,1.5\n")
    _write(tmp_path / name / "other.txt", "ignored")
    assert [r.name for r in files.read_results(spark, [a], SCHEMA, ragged=False).collect()] == ["x"]
    listed = files.classify_files(spark, str(tmp_path / name)).filter("incidence_estimates").collect()
    out = files.read_results(spark, [r.path for r in listed], SCHEMA, path_col="path").collect()
    assert [(r.name, r.path.removeprefix("file://").removeprefix("file:")) for r in out] == [("x", a)]


def _groups(spark, paths):
    found = files.header_signatures(spark, paths)
    return {h: sorted(p.replace("file://", "file:") for p in ps) for h, ps in found.items()}


def test_headers_of_small_and_large_files(spark, tmp_path, monkeypatch):
    paths = [_write(tmp_path / "My DB" / f"{k} 50%.csv", f"\ufeffname,c{k % 2}\r\nx,{k}\r\n") for k in range(5)]
    paths = [f"file:{p}" for p in paths]
    want = {"name,c0": [paths[0], paths[2], paths[4]], "name,c1": [paths[1], paths[3]]}
    assert _groups(spark, paths) == want
    monkeypatch.setattr(files, "SMALL_FILE", 0)
    assert _groups(spark, paths) == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert _groups(spark, paths[:1]) == {"name,c0": paths[:1]} and spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def _bytes_read(spark):
    """What this machine's file system has handed out so far."""
    seen = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(x.getBytesRead() for x in seen if x.getScheme() == "file")


def test_a_header_is_read_and_not_the_file_in_a_store_only_spark_opens(spark, tmp_path):
    from pyarrow import fs

    big = tmp_path / "in" / "big.csv"
    big.parent.mkdir()
    with big.open("wb") as out:
        out.write(b"name,n,v\n")
        for _ in range(25):
            out.write(b"x,1,1.5\n" * 1_000_000)
    assert big.stat().st_size > 200_000_000
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.store.link./in", f"file:{big.parent}")
    with pytest.raises(Exception):
        fs.FileSystem.from_uri("viewfs://store/in/big.csv")
    before = _bytes_read(spark)
    found = files.header_signatures(spark, ["viewfs://store/in/big.csv"])
    assert found == {"name,n,v": ["viewfs://store/in/big.csv"]}
    assert _bytes_read(spark) - before < 1_000_000
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.header_signatures(spark, ["viewfs://store/in/none.csv"])


@pytest.mark.parametrize("first", ["name,n,v", "namex,n,v"])
@pytest.mark.parametrize("many", [70_000, 700_000])
def test_characters_may_lie_across_any_byte(spark, tmp_path, first, many):
    """Multi-byte characters at even and odd places, in files below and above the size read whole."""
    a = tmp_path / "a.csv"
    a.write_text(f"{first}\n" + "é" * many + ",1,1.5\n", encoding="utf-8")
    rows = files.read_results(spark, [str(a)], SCHEMA, extras=True).collect()
    assert [(r.n, r.v) for r in rows] == [(1, 1.5)] and max(len(x) for x in rows[0] if isinstance(x, str)) == many


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_files_that_are_not_utf8_fail_by_name(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(files, "SMALL_FILE", small)
    a, b = tmp_path / "head latin.csv", tmp_path / "body latin.csv"
    a.write_bytes("name,n,v,Größe\nx,1,1.5,2\n".encode("latin-1"))
    b.write_bytes("name,n,v\nGröße,1,1.5\n".encode("latin-1"))
    with pytest.raises(Exception, match="head latin.csv is not UTF-8"):
        files.read_results(spark, [str(a)], SCHEMA)
    with pytest.raises(Exception, match="not UTF-8 text in .*body%20latin.csv"):
        files.read_results(spark, [str(b)], SCHEMA).collect()
    # Columns that are not read are not looked at.
    assert [r.n for r in files.read_results(spark, [str(b)], SCHEMA).select("n").collect()] == [1]


def test_empty_files_give_no_rows(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "")
    out = files.read_results(spark, [a], SCHEMA, path_col="path")
    assert out.columns == ["name", "n", "v", "path"] and out.count() == 0
    b = _write(tmp_path / "b.csv", "name,n,v\nx,1,1.5\n")
    assert files.read_results(spark, [a, b], SCHEMA).count() == 1


def test_export_keeps_edge_blanks_and_line_breaks(spark, tmp_path):
    rows = [(" lead", 1, 1.0), ("trail ", 2, 2.0), ("two\nlines", 3, 3.0), (' "q" ', 4, 4.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    files.write_export(df, str(tmp_path / "x"), ["n"])
    back = files.read_export(spark, str(tmp_path / "x"), SCHEMA, multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_covariate_columns_are_matched_by_name_and_strict(spark, tmp_path):
    _write(tmp_path / "c" / "a.csv", "Day,Entity,x y\n2020-01-01,A,1.5\n")
    _write(tmp_path / "c" / "b.csv", "x y,extra,Day,Entity\n2.5,e,2020-01-02,B\nNA,e,NA,B\n")
    names = {"Entity": "country", "Day": "date", "x.y": "si"}
    out = files.covariate_series(spark, str(tmp_path / "c"), names, "date", ["si"])
    day = dt.date(2020, 1, 1)
    assert {tuple(r) for r in out.collect()} == {("A", day, 1.5), ("B", dt.date(2020, 1, 2), 2.5), ("B", None, None)}
    bad = _write(tmp_path / "bad.csv", "Day,Entity,x y\nsoon,A,1.5\n")
    with pytest.raises(Exception, match="date is not a date: soon"):
        files.covariate_series(spark, bad, names, "date", ["si"]).collect()
