"""Model input of the interrupted time series against plain Python on small frames."""

import datetime as dt
import random
from collections import defaultdict

from strataflow.operators.aggregates import series_status
from strataflow.plans.series import raw_rate_series, sr_series_monthly, sr_series_quarterly

SCHEMA = (
    "database_name string, outcome_cohort_name string, denominator_age_group string, denominator_sex string, "
    "analysis_interval string, incidence_start_date date, n_events double, person_years double"
)
TP = dt.date(2020, 4, 1)


def _frame(spark, rows):
    return spark.createDataFrame([(db, o, "all", "Both", "months", d, y, pt) for db, o, d, y, pt in rows], SCHEMA)


def _by_hand(rows, timepoints, months):
    """The rules, one after the other, on lists."""
    cells = defaultdict(list)
    for db, o, d, y, pt in rows:
        start = d if months == 1 else dt.date(d.year, (d.month - 1) // 3 * 3 + 1, 1)
        cells[db, o, start].append((1.0 if y is None else y, pt))
    series = defaultdict(list)
    for (db, o, start), values in cells.items():
        pts = [pt for _, pt in values]
        total = None if None in pts else sum(pts)
        for tp in timepoints:
            if start != tp:
                series[db, o, tp].append((start, sum(y for y, _ in values), total))
    out = set()
    for (db, o, tp), periods in series.items():
        periods.sort()
        while periods and periods[0][1] == 0:
            periods.pop(0)
        kept = [p for p in periods if p[2] is not None]
        for t, (start, y, pt) in enumerate(kept, start=1):
            out.add((db, o, tp, start, y if y else 5.0, round(pt, 6), int(start >= tp), t))
    return out


def _result(df):
    return {
        (r.database_name, r.outcome_cohort_name, r.timepoint, r.incidence_start_date, r.n_events_sum,
         round(r.person_years_sum, 6), r.intrv, r.time)
        for r in df.collect()
    }


def _random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for db in ("A", "B", "C"):
        for o in ("x", "y"):
            lead = rng.randrange(0, 12)
            for i in range(36):
                if rng.random() < 0.15:
                    continue
                d = dt.date(2018 + i // 12, i % 12 + 1, 1)
                y = 0.0 if i < lead or (db == "C" and o == "y") else rng.choice([None, 0.0, 0.0, 3.0, 8.0])
                pt = None if rng.random() < 0.05 else round(rng.uniform(10, 99), 2)
                rows.append((db, o, d, y, pt))
    return rows


def test_series_match_the_rules_applied_by_hand(spark):
    timepoints = [dt.date(2020, 3, 1), TP]
    for seed in (1, 2):
        rows = _random_rows(seed)
        df = _frame(spark, rows)
        assert _result(sr_series_quarterly(df, timepoints=timepoints)) == _by_hand(rows, timepoints, 3)
        assert _result(sr_series_monthly(df, timepoints=timepoints)) == _by_hand(rows, timepoints, 1)


def test_other_intervals_are_left_out(spark):
    df = _frame(spark, [("A", "x", dt.date(2020, 1, 1), 4.0, 9.0)])
    from pyspark.sql import functions as F

    assert sr_series_quarterly(df.withColumn("analysis_interval", F.lit("years")), timepoints=[TP]).count() == 0


def test_status_tells_why_a_series_is_missing(spark):
    rows = [
        ("A", "ok", dt.date(2020, 1, 1), 4.0, 9.0),
        ("A", "zero", dt.date(2020, 1, 1), 0.0, 9.0),
        ("A", "COVID-19 infection", dt.date(2020, 1, 1), 4.0, 9.0),
        ("A", "no time", dt.date(2020, 1, 1), 0.0, 9.0),
        ("A", "no time", dt.date(2020, 4, 1), 4.0, None),
    ]
    from strataflow.operators.aggregates import quarterly_rollup
    from strataflow.plans.series import STRATUM

    rolled = quarterly_rollup(_frame(spark, rows), STRATUM)
    out = {r.outcome_cohort_name: r.status for r in series_status(rolled, STRATUM).collect()}
    assert out == {"ok": "ok", "zero": "no_records", "COVID-19 infection": "post_event_outcome", "no time": "no_records"}


def test_raw_rates_drop_missing_ones(spark):
    from pyspark.sql import functions as F

    df = _frame(spark, [("A", "x", dt.date(2020, 1, 1), 4.0, 9.0), ("A", "x", dt.date(2020, 2, 1), None, 9.0)])
    df = df.withColumns({c: F.col("n_events") for c in ("incidence", "incidence_95CI_lower", "incidence_95CI_upper")})
    out = raw_rate_series(df, [TP, "2020-03-01"]).collect()
    assert len(out) == 2 and {r.Model for r in out} == {"Raw incidence"}
