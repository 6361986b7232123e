"""Fixed dimensions: database aliases and countries, timepoints, outcome labels."""

from __future__ import annotations

from datetime import date
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values -------------------------------------------------------------------------
# These must equal what existing result sets were labelled with, spelling included.

DATABASE_ALIASES = {
    "The National Health Insurance Service?National Sample Cohort": "YUHS",
}

DATABASE_COUNTRY = {
    "CPRDGOLD": "United Kingdom",
    "PharMetrics": "United States",
    "THINBE": "Belgium",
    "THINES": "Spain",
    "THINFR": "France",
    "THINIT": "Italy",
    "THINRO": "Romania",
    "THINUK": "United Kingdom",
}

CASE_COUNTRIES = ("France", "Romania", "Spain", "Italy", "Belgium")
INDEX_COUNTRIES = (*CASE_COUNTRIES, "United Kingdom", "United States")

TIMEPOINTS = {
    "AllFirstQuarter": date(2020, 3, 1),
    "AllSecondQuarter": date(2020, 4, 1),
}

# Rows of these databases after the cutoff are of poor quality.
QUALITY_PATTERN, QUALITY_CUTOFF = "THIN", date(2023, 1, 1)

OUTCOME_LABELS = {
    "covid_infection": "COVID-19 infection",
    "influenza": "Influenza",
    "asthma": "Asthma",
    "breastcancer": "Breast cancer",
    "colorectalcancer": "Colorectal cancer",
    "dementia": "Dementia",
    "hypertension": "Hypertension",
    "hypothyroidism": "Hypothyroidism",
    "ibd": "Iflammatory bowel disease",
    "longcovid_code": "Post-acute COVID-19 condition code",
    "osteoporosis": "Osteoporosis",
    "rheumatoidarthritis": "Rheumatoid arthritis",
    "atrial_fibrillation": "Atrial fibrillation",
    "systemiclupus": "Systemic lupus",
    "er_and_admissions": "ER and hospital admissions",
    "outpatient_visits": "Outpatient visits",
    "long_covid_one_symptom": "Post-acute COVID-19 one symptom",
    "long_covid_two_symptoms": "Post-acute COVID-19 two symptoms",
    "long_covid_three_symptoms": "Post-acute COVID-19 three symptoms",
    "pasc_one_event": "Post-acute COVID-19 one complication",
    "pasc_two_events": "Post-acute COVID-19 two complications",
    "pasc_three_events": "Post-acute COVID-19 three complications",
    "deep_vein_thrombosis": "Deep vein thrombosis",
    "heart_failure": "Heart failure",
    "ischemic_stroke": "Ischemic stroke",
    "myocardial_infarction": "Myocardial infraction",
    "myocarditis_pericarditis": "Myocarditis and pericarditis",
    "pulmonary_embolism": "Pulmonary embolism",
    "transient_ischemic_attack": "Transient ischemic attack",
    "venous_thrombosembolism": "Venous thromboembolism",
    "ventricular_arrhythmia_cardiac_arrest": "Ventricular arrythmia and cardiac arrest",
    "haemorrhagic_stroke": "Haemorrhagic stroke",
}

# Path pattern -> time at risk; the first match wins.
TIME_AT_RISK_RULES = (("tar30", "30"), ("tar365", "365"))
TIME_AT_RISK_DEFAULT = "Inf"
# ---- End of fixed values ------------------------------------------------------------------


def literal_table(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A short table that lives in the plan itself, so Spark knows its size and may broadcast it."""
    structs = [
        F.struct(*[F.lit(v).alias(c) for v, c in zip(row, columns, strict=True)]) for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def mapping_table(
    spark: SparkSession, mapping: Mapping[str, object], key: str, value: str
) -> DataFrame:
    return literal_table(spark, list(mapping.items()), [key, value])


def literal_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """The fixed dimensions as DataFrames."""
    return {
        "timepoints": mapping_table(spark, TIMEPOINTS, "Database", "Timepoint"),
        "database_country": mapping_table(spark, DATABASE_COUNTRY, "database", "country"),
        "outcome_labels": mapping_table(spark, OUTCOME_LABELS, "code", "label"),
    }
