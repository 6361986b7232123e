"""From a folder of per-database result files to tidy tables."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import as_col
from ..operators.aggregates import distinct_cohorts, monthly_sum_country
from ..operators.filters import country_whitelist, quality_cutoff
from ..operators.projections import (
    alias_recode,
    calendar_parts,
    label_recode,
    null_default,
    path_tag,
    rename_display,
)
from ..sources import dims, schemas
from ..sources.commits import publish, published, versions, write_laid_out
from ..sources.files import FILE_CLASSES, classify_files, classify_paths, covariate_series, literal_path, read_results

# Short names of the rate columns.
RATE_NAMES = {
    "incidence_100000_pys": "incidence",
    "incidence_100000_pys_95CI_lower": "incidence_95CI_lower",
    "incidence_100000_pys_95CI_upper": "incidence_95CI_upper",
}

# How the large tables are laid out.
SILVER_LAYOUT = {"incidence_estimates": ["database_name", "analysis_interval"]}
# Tables of distinct rows over all files.
DISTINCT_TABLES = {"denominator_cohorts"}
# The table of files an incremental load has read.
LOADED = "loaded_files"


def tidy_estimates(df: DataFrame) -> DataFrame:
    """Names, aliases, calendar columns and defaults of the estimates."""
    df = alias_recode(rename_display(df, RATE_NAMES), "cdm_name", dims.DATABASE_ALIASES)
    df = calendar_parts(df, "incidence_start_date")
    df = rename_display(df, {"cdm_name": "database_name"})
    return null_default(df, "denominator_target_cohort_name", "all_population")


def paths_by_class(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """File paths per class. Names of files of a class are planning metadata, as in any scan."""
    found: dict[str, list[str]] = {name: [] for name in FILE_CLASSES}
    of_a_class = reduce(or_, [F.col(name) for name in FILE_CLASSES])
    for row in classify_files(spark, root).filter(of_a_class).collect():
        for name in FILE_CLASSES:
            if row[name]:
                found[name].append(row["path"])
    return found


def load_results(spark: SparkSession, root: str, ragged: bool = True) -> dict[str, DataFrame]:
    """All tables of a result folder, tidied, by name; a class without files is absent."""
    return _tables(spark, paths_by_class(spark, root), ragged)


def _tables(spark: SparkSession, paths: Mapping[str, list[str]], ragged: bool) -> dict[str, DataFrame]:
    def read(name: str, schema, path_col: str | None = None) -> DataFrame | None:
        if not paths[name]:
            return None
        return read_results(spark, paths[name], schema, ragged, path_col, extras=ragged)

    tables: dict[str, DataFrame | None] = {"snapshot": read("snapshot", schemas.SNAPSHOT)}
    estimates = read("incidence_estimates", schemas.INCIDENCE_ESTIMATES, "path")
    if estimates is not None:
        tagged = path_tag(estimates, "path", dims.TIME_AT_RISK_RULES, dims.TIME_AT_RISK_DEFAULT)
        tidy = tidy_estimates(tagged.drop("path"))
        # Cohort attributes are taken before poor-quality dates are removed.
        tables["denominator_cohorts"] = distinct_cohorts(
            tidy, ["denominator_cohort_name", "denominator_sex", "denominator_age_group"]
        )
        kept = quality_cutoff(
            tidy, "database_name", dims.QUALITY_PATTERN, "incidence_start_date", dims.QUALITY_CUTOFF
        )
        tables["incidence_estimates"] = label_recode(kept, "outcome_cohort_name", dims.OUTCOME_LABELS)
    attrition = read("incidence_attrition", schemas.INCIDENCE_ATTRITION)
    if attrition is not None:
        tables["incidence_attrition"] = label_recode(
            alias_recode(attrition, "cdm_name", dims.DATABASE_ALIASES),
            "outcome_cohort_name",
            dims.OUTCOME_LABELS,
        )
    characterisation = read("characterisation", schemas.SUMMARISED_RESULT)
    if characterisation is not None:
        tables["characterisation"] = characterisation.withColumn("result_id", F.lit(1))
    tables["attrition_infection"] = read("attrition_infection", schemas.SUMMARISED_RESULT)
    return {name: df for name, df in tables.items() if df is not None}


def monthly_cases(spark: SparkSession, path: str) -> DataFrame:
    """Monthly case totals of the covered countries."""
    cases = covariate_series(
        spark,
        path,
        {"month": "month", "year": "year", "cases": "cases", "countriesAndTerritories": "country"},
        number_cols=["cases"],
    )
    cases = cases.withColumns({c: as_col(c).try_cast("int") for c in ("month", "year")})
    return monthly_sum_country(country_whitelist(cases, "country", dims.CASE_COUNTRIES))


def policy_index(spark: SparkSession, path: str) -> DataFrame:
    """Daily policy index of the covered countries as (country, date, si)."""
    index = covariate_series(
        spark,
        path,
        {"Entity": "country", "Day": "date", "Stringency.index..weighted.average.": "si"},
        date_col="date",
        number_cols=["si"],
    )
    return country_whitelist(index, "country", dims.INDEX_COUNTRIES)


def write_silver(
    tables: Mapping[str, DataFrame], root: str, partition_by: Mapping[str, list[str]] | None = None
) -> None:
    """Write tidied tables as Parquet, estimates laid out by database and interval."""
    layout = {**SILVER_LAYOUT, **(partition_by or {})}
    for name, df in tables.items():
        write_laid_out(df, f"{root.rstrip('/')}/{name}", layout.get(name, []))


def load_new(spark: SparkSession, source: str, root: str, ragged: bool = True) -> int:
    """Publish what a result folder's new files hold, and return the version of the lake at ``root``.

    Only files that no earlier load has read are read, and only their paths reach the driver: the
    folder's listing meets the table ``loaded_files`` in an anti-join. Their rows, and their names in that
    table, become visible in one commit, so a load that dies can be run again. Cohort
    attributes are kept distinct over all loads. Without new files nothing is committed. A file that
    was changed after it was loaded fails by name; rows of files that were removed since stay. A folder
    without files of a class gives version 0.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(literal_path(source))
    found = classify_paths(listed.select("path", "length", F.col("modificationTime").alias("modified")))
    found = found.filter(reduce(or_, [F.col(name) for name in FILE_CLASSES]))
    before = published(spark, root)
    if LOADED in before:
        known = before[LOADED].select("path", F.struct("length", "modified").alias("was"))
        now = F.struct("length", "modified")
        changed = found.join(known.filter(as_col("was").isNotNull()), "path").filter(now != as_col("was"))
        names = [r["path"] for r in changed.select("path").orderBy("path").limit(10).collect()]
        if names:
            raise ValueError(f"changed since they were loaded: {', '.join(names)}")
        found = found.join(known, "path", "left_anti")
    rows = found.collect()
    if not rows:
        return max(versions(spark, root), default=0)
    tables = _tables(spark, {name: [r["path"] for r in rows if r[name]] for name in FILE_CLASSES}, ragged)
    # What was read, not what the folder holds by now.
    files = [(r["path"], r["length"], r["modified"]) for r in rows]
    tables[LOADED] = spark.createDataFrame(files, "path string, length long, modified timestamp")
    for name in DISTINCT_TABLES & set(tables) & set(before):
        tables[name] = before[name].unionByName(tables[name]).distinct()
    return publish(spark, root, tables, append=set(tables) - DISTINCT_TABLES, layout=SILVER_LAYOUT)
