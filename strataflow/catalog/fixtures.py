"""Stand-in result tables derived from the sales tables.

Roles: database = region, outcome = order priority, age group = market segment, sex = order
status, period = order month, person-years = order value / 1000, index = mean quantity shipped per
day. Suppressed counts, leading zeros, an all-zero stratum and a NULL month are built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIMEPOINTS = ("1998-03-01", "1998-04-01")

# Declared, so that opening a table starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _orders_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .withColumn("o_orderdate", F.to_date("o_orderdate"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name"
    )


def _grains() -> Column:
    """Each stratum with its totals: every age group or all ages, every sex or both."""
    return F.explode(
        F.array(
            *[
                F.struct(age.alias("age"), sex.alias("sex"))
                for age in (F.col("c_mktsegment"), F.lit("0 to 150"))
                for sex in (F.col("o_orderstatus"), F.lit("Both"))
            ]
        )
    )


def incidence(spark: SparkSession, sf_dir: str, persons: bool = True) -> DataFrame:
    """Monthly incidence per stratum.

    Rows are added up to the finest stratum first and only those sums are repeated for the totals.
    Counting persons needs their ids up to the end, so ``persons=False`` spares the cost of it.
    """
    no_event = ((F.col("r_name") == "AMERICA") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("date"))) | (
        (F.col("r_name") == "EUROPE") & (F.col("o_orderpriority") == "5-LOW")
    )
    person = ["o_custkey"] if persons else []
    finest = (
        _orders_by_region(spark, sf_dir)
        .groupBy(
            F.col("r_name").alias("database_name"),
            F.col("o_orderpriority").alias("outcome_cohort_name"),
            F.trunc("o_orderdate", "MM").alias("incidence_start_date"),
            "c_mktsegment",
            "o_orderstatus",
            *person,
        )
        .agg(
            F.sum(F.when(no_event, 0).otherwise(1)).alias("events"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value"),
        )
    )
    counted = [F.count_distinct("o_custkey").alias("n_persons")] if persons else []
    cells = (
        finest.withColumn("grain", _grains())
        .groupBy(
            "database_name",
            "outcome_cohort_name",
            F.col("grain.age").alias("denominator_age_group"),
            F.col("grain.sex").alias("denominator_sex"),
            F.lit("months").alias("analysis_interval"),
            "incidence_start_date",
        )
        .agg(
            *counted,
            F.sum("events").alias("raw_events"),
            (F.sum("value").cast("double") / 1000).alias("pt"),
        )
    )
    gap = (F.col("database_name") == "ASIA") & (
        F.col("incidence_start_date") == F.lit("1998-08-01").cast("date")
    )
    return cells.select(
        "database_name",
        "outcome_cohort_name",
        "denominator_age_group",
        "denominator_sex",
        "analysis_interval",
        "incidence_start_date",
        *(["n_persons"] if persons else []),
        F.when(~F.col("raw_events").between(1, 2), F.col("raw_events").cast("double")).alias("n_events"),
        F.when(~gap, F.col("pt")).alias("person_years"),
    )


def with_intervals(df: DataFrame) -> DataFrame:
    """Rows of other analysis intervals beside the monthly ones."""
    months = F.col("n_events") * 3
    other = [
        df.withColumns({"analysis_interval": F.lit(name), "n_events": months}) for name in ("quarters", "years")
    ]
    return df.unionByName(other[0]).unionByName(other[1])


def rates(spark: SparkSession, sf_dir: str, persons: bool = True) -> DataFrame:
    spread = F.lit(1.96) * F.sqrt("n_events")

    def rate(events):
        return F.round(events * 100000 / F.col("person_years"), 4)

    return incidence(spark, sf_dir, persons).withColumns(
        {
            "incidence_end_date": F.last_day("incidence_start_date"),
            "incidence_100000_pys": rate(F.col("n_events")),
            "incidence_100000_pys_95CI_lower": rate(
                F.when(F.col("n_events").isNotNull(), F.greatest(F.col("n_events") - spread, F.lit(0.0)))
            ),
            "incidence_100000_pys_95CI_upper": rate(F.col("n_events") + spread),
            "denominator_cohort_name": F.concat(
                "outcome_cohort_name", F.lit(" denominator "), "denominator_sex"
            ),
            "denominator_target_cohort_name": F.when(F.col("denominator_sex") != "Both", F.lit("target")),
        }
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    daily = shipped.groupBy(
        F.col("r_name").alias("country"), F.to_date("l_shipdate").alias("date")
    ).agg(
        F.round(
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)), 4
        ).alias("si")
    )
    gap = (F.col("country") == "ASIA") & (F.col("date") == F.lit("1998-02-01").cast("date"))
    return daily.withColumn("si", F.when(~gap, F.col("si")))


def summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _orders_by_region(spark, sf_dir).select(
        F.col("r_name").alias("cdm_name"),
        F.col("o_orderpriority").alias("cohort"),
        F.col("c_mktsegment").alias("seg"),
        F.col("o_orderstatus").alias("st"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("v"),
    )
    # Three grains in one aggregation: whole cohort, segment x status, status.
    grain = F.explode(
        F.array(
            F.struct(F.lit("overall").alias("kind"), F.lit("overall").alias("level"), F.lit(None).cast("string").alias("sex")),
            F.struct(F.lit("age_group &&& sex").alias("kind"), F.concat("seg", F.lit(" &&& "), "st").alias("level"), F.lit(None).cast("string").alias("sex")),
            F.struct(F.lit("status").alias("kind"), F.lit("overall").alias("level"), F.col("st").alias("sex")),
        )
    )
    cells = (
        base.withColumn("g", grain)
        .groupBy("cdm_name", "cohort", "g.kind", "g.level", "g.sex")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.floor(F.sum("v").cast("double") / F.count(F.lit(1))).cast("string").alias("mn"),
            F.min("v").cast("string").alias("lo"),
            F.max("v").cast("string").alias("hi"),
        )
    )
    overall = F.col("kind") == "overall"
    none = F.lit(None).cast("string")

    def row(variable, level, name, kind, value):
        return F.struct(
            F.lit(variable).alias("variable_name"),
            level.alias("variable_level"),
            F.lit(name).alias("estimate_name"),
            F.lit(kind).alias("estimate_type"),
            value.alias("estimate_value"),
        )

    n = F.col("n").cast("string")
    stratum_rows = F.array(
        row("Number records", none, "count", "integer", n),
        row("Order value", none, "mean", "numeric", F.col("mn")),
        row(
            "Order value", none, "min", "numeric",
            F.when(~((F.col("cdm_name") == "ASIA") & overall), F.col("lo")),
        ),
    )
    top = F.when(
        ~((F.col("cdm_name") == "EUROPE") & overall),
        row("Order value", none, "max", "numeric", F.col("hi")),
    )
    status_rows = F.array(
        row("Sex", F.col("sex"), "count", "integer", n),
        row("First date", none, "min", "date", F.lit("1995-01-01")),
    )
    rows = F.when(F.col("kind") == "status", status_rows).otherwise(
        F.concat(stratum_rows, F.array_compact(F.array(top)))
    )
    return cells.select(
        F.lit(1).alias("result_id"),
        "cdm_name",
        F.lit("cohort_name").alias("group_name"),
        F.col("cohort").alias("group_level"),
        F.when(F.col("kind") == "age_group &&& sex", F.col("kind")).otherwise(F.lit("overall")).alias("strata_name"),
        F.col("level").alias("strata_level"),
        F.inline(rows),
    ).withColumns({"additional_name": F.lit("overall"), "additional_level": F.lit("overall")})


def characterisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summarised results in which two cohorts keep their name and the others are denominators."""
    own = F.col("group_level").isin("1-URGENT", "5-LOW")
    return summarised(spark, sf_dir).withColumn(
        "group_level",
        F.when(own, F.col("group_level")).otherwise(F.concat("group_level", F.lit(" denominator Both"))),
    )


def attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost_at = (
        F.when(F.col("o_orderstatus") == "P", 1)
        .when(F.col("o_totalprice") < 100000, 2)
        .when(F.col("o_orderdate") < F.lit("1996-01-01").cast("date"), 3)
        .otherwise(4)
    )
    reasons = ("Initial events", "Not partial", "Value at least 100000", "In study period")
    reason = F.element_at(F.array(*[F.lit(r) for r in reasons]), F.col("reason_id"))
    steps = (
        _orders_by_region(spark, sf_dir)
        .select(
            F.col("r_name").alias("cdm_name"),
            F.col("o_orderpriority").alias("outcome_cohort_name"),
            F.col("o_custkey").alias("subject"),
            F.explode(F.sequence(F.lit(1), lost_at)).alias("reason_id"),
        )
        .groupBy("cdm_name", "outcome_cohort_name", "reason_id")
        .agg(
            F.count(F.lit(1)).alias("number_records"),
            F.count_distinct("subject").alias("number_subjects"),
        )
    )
    w = W.partitionBy("cdm_name", "outcome_cohort_name").orderBy("reason_id")

    def lost(c):
        return F.coalesce(F.lag(c).over(w) - F.col(c), F.lit(0))

    return steps.withColumns(
        {
            "reason": reason,
            "excluded_records": lost("number_records"),
            "excluded_subjects": lost("number_subjects"),
        }
    )


COUNTS = ("number_records", "number_subjects", "excluded_records", "excluded_subjects")


def attrition_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attrition as a summarised result: one row per step and count."""
    counts = F.array(
        *[
            F.struct(F.lit(c).alias("variable_name"), F.col(c).cast("string").alias("estimate_value"))
            for c in COUNTS
        ]
    )
    return attrition(spark, sf_dir).select(
        "cdm_name",
        F.lit("cohort_name").alias("group_name"),
        F.col("outcome_cohort_name").alias("group_level"),
        F.lit("reason").alias("strata_name"),
        F.col("reason").alias("strata_level"),
        F.lit("reason_id").alias("additional_name"),
        F.col("reason_id").alias("additional_level"),
        F.lit("count").alias("estimate_name"),
        F.lit("integer").alias("estimate_type"),
        F.inline(counts),
    )
