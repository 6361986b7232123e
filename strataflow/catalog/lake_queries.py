"""Registered queries: every class of result file, written as statistics programs do and loaded back.

Each query writes its files when it is called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import incidence, lake, table_one
from ..sources.commits import publish, published, versions
from ..sources.scratch import materialise, shared_folder
from . import fixtures as fx
from .registry import query
from .shape_queries import DATABASES, PARTS, TABLE_ONE_SQL, cohorts
from .tidy_queries import PRIORITY_LABELS


def _written(df: DataFrame, name: str, root: str | None = None) -> str:
    """A folder of quoted CSV with an unnamed row index, ``NA`` and ``TRUE``/``FALSE``."""
    flags = {f.name: F.upper(F.col(f.name).cast("string")) for f in df.schema if f.dataType == T.BooleanType()}
    root = root or f"{shared_folder(df.sparkSession, 'lake')}/My DB [v1]"
    indexed = df.withColumns(flags).select(F.monotonically_increasing_id().alias(""), "*")
    options = {"header": True, "quoteAll": True, "nullValue": "NA", "escape": '"'}
    indexed.write.options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{root}/{name}")
    return root


@query(
    "load_attrition",
    """SELECT cdm_name, outcome_cohort_name, CAST(reason_id AS INTEGER) AS reason_id, reason,
    CAST(number_records AS DOUBLE) AS number_records, CAST(number_subjects AS DOUBLE) AS number_subjects,
    CAST(excluded_records AS DOUBLE) AS excluded_records, CAST(excluded_subjects AS DOUBLE) AS excluded_subjects,
    cdm_name <> 'ASIA' AS analysis_complete_database_intervals FROM fx_attrition""",
)
def load_attrition(spark, d):
    complete = (F.col("cdm_name") != "ASIA").alias("analysis_complete_database_intervals")
    given = fx.attrition(spark, d).select("*", complete)
    root = _written(given, "Incidence_attrition.csv")
    return lake.load_results(spark, root)["incidence_attrition"].select(*given.columns)


@query(
    "load_snapshot",
    """SELECT r_name AS cdm_name, 'region "' || r_name || '"' AS cdm_source_name, CAST(COUNT(DISTINCT n_name) AS VARCHAR) AS cdm_version,
    CASE WHEN r_name <> 'ASIA' THEN CAST(COUNT(*) AS VARCHAR) END AS snapshot_date
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def load_snapshot(spark, d):
    placed = fx.table(spark, d, "customer").join(fx.places(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
    snapshot = placed.groupBy(F.col("r_name").alias("cdm_name")).agg(
        F.count_distinct("n_name").alias("cdm_version"), F.count(F.lit(1)).alias("n")
    )
    given = snapshot.select(
        "cdm_name",
        F.concat(F.lit('region "'), "cdm_name", F.lit('"')).alias("cdm_source_name"),
        "cdm_version",
        F.when(F.col("cdm_name") != "ASIA", F.col("n")).alias("snapshot_date"),
    )
    return lake.load_results(spark, _written(given, "snapshot.csv"))["snapshot"].select(*given.columns)


@query("lake_table_one", TABLE_ONE_SQL)
def lake_table_one(spark, d):
    root = _written(fx.characterisation(spark, d), "tableOne.csv")
    loaded = lake.load_results(spark, root)["characterisation"]
    return table_one.table_one(
        loaded, cohorts(spark, d), labels=PRIORITY_LABELS, databases=DATABASES, columns=PARTS
    )


@query(
    "lake_attrition_flow",
    """SELECT cdm_name, outcome_cohort_name AS cohort_name, CAST(reason_id AS DOUBLE) AS reason_id, reason,
    CAST(number_records AS VARCHAR) AS number_records, CAST(number_subjects AS VARCHAR) AS number_subjects,
    CAST(excluded_records AS VARCHAR) AS excluded_records, CAST(excluded_subjects AS VARCHAR) AS excluded_subjects,
    CAST(ROW_NUMBER() OVER w AS INTEGER) AS step, CAST(LEAD(excluded_records) OVER w AS VARCHAR) AS lost_records,
    CAST(LEAD(excluded_subjects) OVER w AS VARCHAR) AS lost_subjects, LEAD(reason) OVER w AS next_reason
    FROM fx_attrition WINDOW w AS (PARTITION BY cdm_name, outcome_cohort_name ORDER BY reason_id)""",
)
def lake_attrition_flow(spark, d):
    root = _written(fx.attrition_long(spark, d), "attrition_infection.csv")
    loaded = lake.load_results(spark, root)["attrition_infection"]
    return incidence.attrition_flow(loaded)


# Files of more than 64 KB whose long text puts characters of two bytes across every buffer's end.
@query(
    "load_accented",
    """SELECT cdm_name, outcome_cohort_name, CAST(reason_id AS INTEGER) AS reason_id, md5(reason || ' ' || repeat('é', 9001)) AS reason
    FROM fx_attrition""",
)
def load_accented(spark, d):
    long = F.concat("reason", F.lit(" "), F.repeat(F.lit("é"), 9001))
    given = fx.attrition(spark, d).withColumn("reason", long)
    loaded = lake.load_results(spark, _written(given.coalesce(1), "Incidence_attrition.csv"))["incidence_attrition"]
    return loaded.select("cdm_name", "outcome_cohort_name", "reason_id", F.md5("reason").alias("reason"))


@query(
    "load_new_files",
    """SELECT cdm_name, outcome_cohort_name, CAST(reason_id AS INTEGER) AS reason_id, reason,
    CAST(number_records AS DOUBLE) AS number_records, CAST(number_subjects AS DOUBLE) AS number_subjects,
    CAST(excluded_records AS DOUBLE) AS excluded_records, CAST(excluded_subjects AS DOUBLE) AS excluded_subjects FROM fx_attrition""",
)
def load_new_files(spark, d):
    """Two loads into one lake: the second reads the files of one more database only."""
    given = materialise(fx.attrition(spark, d), "attrition")
    late = F.col("cdm_name") == "ASIA"
    lake_root = f"{shared_folder(spark, 'silver')}/silver"
    root = _written(given.filter(~late), "first/Incidence_attrition.csv")
    lake.load_new(spark, root, lake_root)
    _written(given.filter(late), "second/Incidence_attrition.csv", root)
    lake.load_new(spark, root, lake_root)
    return published(spark, lake_root)["incidence_attrition"].select(*given.columns)


@query(
    "lake_versions",
    """WITH o AS (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 'P' END AS state, o_custkey % 3 AS third FROM orders),
    v AS (SELECT 1 AS version, * FROM o WHERE third = 0 UNION ALL SELECT 2, * FROM o WHERE third < 2
      UNION ALL SELECT 3, * FROM o WHERE third = 2)
    SELECT version, o_orderpriority, state, COUNT(*) AS orders FROM v GROUP BY ALL""",
)
def lake_versions(spark, d):
    """A table begun, added to and replaced: each version stays readable."""
    orders = fx.table(spark, d, "orders").select(
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", F.lit("P")).alias("state"),
        (F.col("o_custkey") % 3).alias("third"),
    )
    root = f"{shared_folder(spark, 'versions')}/lake"
    for third, append in ((0, ()), (1, ["orders"]), (2, ())):
        part = {"orders": orders.filter(F.col("third") == third).drop("third")}
        publish(spark, root, part, append, layout={"orders": ["o_orderpriority"]})
    counted = [
        published(spark, root, v)["orders"].groupBy(F.lit(v).alias("version"), "o_orderpriority", "state").agg(
            F.count(F.lit(1)).alias("orders")
        )
        for v in versions(spark, root)
    ]
    return reduce(DataFrame.unionByName, counted)
