"""Missing-value rules that differ from Spark's defaults.

The results this library reads treat a missing value as contagious in sums and means, as an
ordinary key in joins, and as "does not match" in text tests. Each rule is one small expression.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    """A column from a name; names are quoted so that spaces and dots in them are literal."""
    if isinstance(c, str):
        return F.col("`" + c.replace("`", "``") + "`")
    return c


def strict_sum(c: Column | str, total: Column | None = None) -> Column:
    """Sum that is NULL as soon as one input is NULL; ``total`` is the way to add up, if not the built-in one."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c) if total is None else total)


def strict_avg(c: Column | str, total: Column | None = None) -> Column:
    """Mean that is NULL as soon as one input is NULL."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c) if total is None else total / F.count(c))


def matches(c: Column | str, pattern: str) -> Column:
    """Regex test in which NULL text simply does not match."""
    return F.coalesce(as_col(c).rlike(pattern), F.lit(False))


def in_set(c: Column | str, values: Iterable) -> Column:
    """Membership that is never NULL; an empty set matches nothing."""
    values = list(values)
    present = [v for v in values if v is not None]
    hit = F.coalesce(as_col(c).isin(present), F.lit(False)) if present else F.lit(False)
    if len(present) < len(values):
        hit = hit | as_col(c).isNull()
    return hit


def one_of(c: Column | str, values: Iterable) -> Column:
    """Membership as a filter condition.

    NULL on no match with NULL, which a filter drops like FALSE; left bare so that it can be pushed
    into the scan and prune partitions, which the total form of :func:`in_set` cannot.
    """
    values = list(values)
    present = [v for v in values if v is not None]
    hit = as_col(c).isin(present) if present else F.lit(False)
    return hit | as_col(c).isNull() if len(present) < len(values) else hit


def plain_text(c: Column | str) -> Column:
    """Text of a value; a floating-point number that Spark would show with an exponent is written out."""
    c = as_col(c)
    shown = c.cast("string")
    digits = F.regexp_replace(shown.try_cast("decimal(38,14)").cast("string"), r"(\.\d+?)0+$", "$1")
    exponent = F.typeof(c).isin("double", "float") & shown.contains("E")
    return F.when(exponent, F.coalesce(digits, shown)).otherwise(shown)


def text_or_na(c: Column | str) -> Column:
    """Text of a value, with NULL shown as ``NA``."""
    return F.coalesce(plain_text(c), F.lit("NA"))


def null_safe_match(left, right, pairs: Iterable[tuple[str, str]]) -> Column:
    """Join condition over column pairs in which NULL equals NULL."""
    return reduce(
        lambda a, b: a & b,
        [left[f"`{lc}`"].eqNullSafe(right[f"`{rc}`"]) for lc, rc in pairs],
    )
