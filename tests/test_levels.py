"""Combined levels whose parts hold the separator."""

import itertools
import random
import re

import pytest

from strataflow.functions.text import LEVEL_SEPARATOR
from strataflow.operators.levels import combined_levels
from strataflow.operators.summarised import split_name_level
from strataflow.plans.incidence import attrition_flow


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, level string")


def ways(name, level, seen):
    """All readings of a level, by trying every choice of separators."""
    names = re.split(LEVEL_SEPARATOR, name)
    cuts = [m.span() for m in re.finditer(LEVEL_SEPARATOR, level)]
    for chosen in itertools.combinations(cuts, len(names) - 1):
        ends = [(0, 0), *chosen, (len(level), len(level))]
        parts = [level[a[1] : b[0]] for a, b in zip(ends, ends[1:])]
        if len(names) == 1 or all((n, p) in seen for n, p in zip(names, parts)):
            yield parts


def test_equals_trying_every_choice(spark):
    rng = random.Random(3)
    words = ["a", "b", "a and b", "b &&& c", "c", "c and a and b", "d"]
    rows = [(n, w) for n in "xyz" for w in rng.sample(words, 4)]
    for _ in range(120):
        names = rng.sample("xyz", rng.randint(2, 3))
        rows.append((" and ".join(names), rng.choice([" and ", " &&& "]).join(rng.choice(words) for _ in names)))
    seen = set()
    for n, l in rows:
        names, pieces = re.split(LEVEL_SEPARATOR, n), re.split(LEVEL_SEPARATOR, l)
        seen |= set(zip(names, [l] if len(names) == 1 else pieces if len(names) == len(pieces) else []))
    longer = {r for r in rows if len(re.split(LEVEL_SEPARATOR, r[1])) > len(re.split(LEVEL_SEPARATOR, r[0]))}
    read = {r: list(ways(*r, seen)) for r in longer}
    sure = [r for r, w in read.items() if len(w) == 1]
    known = {}
    for n, l in seen:
        known.setdefault(n, []).append(l)
    got = {(r.name, r.level): r.parts for r in combined_levels(frame(spark, sure), "name", "level", known).collect()}
    assert len(got) > 20 and got == {r: read[r][0] for r in sure}
    none, several = ([r for r, w in read.items() if bool(w) is many and len(w) != 1] for many in (False, True))
    assert none and several
    for rows, message in ((none, "not made up of known"), (several, "several ways")):
        for r in rows[:3]:
            with pytest.raises(Exception, match=message):
                combined_levels(frame(spark, [r]), "name", "level", known).collect()


def test_levels_seen_elsewhere_are_enough(spark):
    df = frame(
        spark,
        [("reason", "Both and age known"), ("sex and reason", "Sex: Both and Both and age known"), ("sex", "Sex: Both"),
         ("overall", "overall"), (None, None), ("sex &&& reason", "Sex: Both &&& other")],
    )
    got = split_name_level(df, "name", "level", columns=["sex", "reason"], known={})
    assert got.columns == ["sex", "reason"]
    assert sorted(map(tuple, got.collect())) == [
        ("Sex: Both", "Both and age known"), ("Sex: Both", "other"), ("Sex: Both", "overall"),
        ("overall", "Both and age known"), ("overall", "overall"), ("overall", "overall"),
    ]
    assert split_name_level(df.limit(0), "name", "level", columns=["sex", "reason"], known={}).count() == 0
    with pytest.raises(Exception, match="different numbers"):  # without known levels as before
        split_name_level(df, "name", "level", columns=["sex", "reason"]).collect()
    short = frame(spark, [("sex and reason", "Sex: Both")])
    with pytest.raises(Exception, match="different numbers"):
        split_name_level(short, "name", "level", columns=["sex", "reason"], known={}).collect()


def test_a_level_may_be_given(spark):
    df = frame(spark, [("sex and age", "Both and 0 and more")])
    with pytest.raises(Exception, match="not made up of known"):
        split_name_level(df, "name", "level", columns=["sex", "age"], known={}).collect()
    got = split_name_level(df, "name", "level", columns=["sex", "age"], known={"sex": ["Both"], "age": ["0 and more"]})
    assert tuple(got.first()) == ("Both", "0 and more")


def test_a_reason_with_the_separator_flows(spark):
    rows = [
        ("A", "cohort_name", "c", "reason", r, "reason_id", str(i), "number_records", "count", "integer", str(9 - i))
        for i, r in enumerate(["Start", "Both and age known"], 1)
    ]
    names = (
        "cdm_name, group_name, group_level, strata_name, strata_level, additional_name, additional_level, variable_name, "
        "estimate_name, estimate_type, estimate_value"
    )
    rows += [(*r[:7], v, *r[8:]) for r in rows for v in ("number_subjects", "excluded_records", "excluded_subjects")]
    df = spark.createDataFrame(rows, names.split(", "))
    assert [r.reason for r in attrition_flow(df, known={}).orderBy("step").collect()] == ["Start", "Both and age known"]
