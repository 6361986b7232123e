"""What is known of a table before a plan is chosen: whether it is stored, and how many keys it has."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import as_col

# Steps that read stored rows one by one; anything else computes, moves or joins.
_NARROW = re.compile(r"^[\s:+|-]*(Project|Filter|Union|Relation)\b")
_UNITS = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}


def is_stored(df: DataFrame) -> bool:
    """Whether a table is read from files with nothing but selections on the way: reading it again is cheap."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().strip("\n").split("\n")
    return all(_NARROW.match(line) for line in plan) and any("Relation " in line for line in plan)


def byte_size(text: str) -> int:
    """A size as Spark's settings spell it, ``10485760b``, ``10MB`` or ``64k``, in bytes."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", text.lower())
    if not found:
        raise ValueError(f"not a size: {text}")
    return int(found[1]) << _UNITS[found[2]] if int(found[1]) > 0 else int(found[1])


def broadcast_limit(spark: SparkSession) -> int:
    return byte_size(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))


def few_keys(df: DataFrame, keys: Sequence[str], values: int = 1) -> bool:
    """Whether one row per key, with so many further values, may be broadcast, as far as a sketch can tell.

    One pass over the key columns: a HyperLogLog count (an error of a few hundredths) and the mean
    length of a key. Only sketches leave the tasks.
    """
    limit = broadcast_limit(df.sparkSession)
    if limit <= 0:
        return False
    columns = [as_col(k) for k in keys]
    length = F.octet_length(F.concat_ws("", *[c.cast("string") for c in columns]))
    found = df.agg(F.approx_count_distinct(F.xxhash64(*columns), 0.02), F.avg(length)).first()
    return found[0] * ((found[1] or 0) + 16 * (len(columns) + values)) <= limit
