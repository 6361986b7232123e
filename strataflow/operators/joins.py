"""Joins.

No broadcast hint is given on anything that grows with the data: Spark broadcasts a side only when
its size, known or measured at run time, is under ``spark.sql.autoBroadcastJoinThreshold``, and
otherwise shuffles, with adaptive splitting of hot keys.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import as_col, null_safe_match
from ..sources.scratch import materialise
from ..sources.stored import few_keys, is_stored


def _join_keeping_left(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], null_safe: bool
) -> DataFrame:
    """Left join; right-hand key columns are left out, the rest must not clash."""
    right_keys = [rc for _, rc in pairs]
    extra = [c for c in right.columns if c not in right_keys]
    clash = [c for c in extra if c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(clash)}")
    lt, rt = left.alias("lt"), right.alias("rt")

    def one(lc: str, rc: str) -> Column:
        a, b = F.col(f"lt.`{lc}`"), F.col(f"rt.`{rc}`")
        return a.eqNullSafe(b) if null_safe else a == b

    on = reduce(lambda x, y: x & y, [one(lc, rc) for lc, rc in pairs])
    return lt.join(rt, on, "left").select(
        *[F.col(f"lt.`{c}`") for c in left.columns], *[F.col(f"rt.`{c}`") for c in extra]
    )


def left_join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on same-named keys, NULL equal to NULL, key columns kept once."""
    return _join_keeping_left(left, right, [(k, k) for k in keys], null_safe=True)


def left_join_attributes(
    df: DataFrame, attrs: DataFrame, left_key: str, right_key: str
) -> DataFrame:
    """Add attributes by key; a key with several attribute rows fans out, NULL matches NULL."""
    return _join_keeping_left(df, attrs, [(left_key, right_key)], null_safe=True)


def join_covariate_month(
    df: DataFrame,
    monthly: DataFrame,
    keys: Mapping[str, str],
    value: str = "si",
    fill: float = 0.0,
) -> DataFrame:
    """Add a monthly covariate by ``{left: right}`` keys; months without one get ``fill``."""
    out = _join_keeping_left(df, monthly, list(keys.items()), null_safe=True)
    return out.withColumn(value, F.coalesce(as_col(value), F.lit(float(fill))))


def join_order_table(df: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Add the rank columns of an order table."""
    return _join_keeping_left(df, order, [(key, key)], null_safe=True)


def null_safe_anti_join(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of ``a`` with no row in ``b`` equal on ``cols``, NULL equal to NULL."""
    b = b.select(*[as_col(c).alias(f"__{c}") for c in cols])
    return a.join(b, null_safe_match(a, b, [(c, f"__{c}") for c in cols]), "left_anti")


def lookup_country(
    df: DataFrame, dim: DataFrame, database_col: str = "database_name", dim_key: str = "database"
) -> DataFrame:
    """Add the country of a database; NULL for one that is not listed."""
    return _join_keeping_left(df, dim, [(database_col, dim_key)], null_safe=False)


def with_group_stats(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column], written: bool | None = None
) -> DataFrame:
    """Attach aggregates of a row's group to every row of it.

    Partial aggregation plus a join rather than a window: no group has to fit in one task, so a
    group holding a large share of the rows is still spread out (adaptive skew handling).

    ``written`` suits few groups: their aggregates go to the shared folder first. The size of a
    written table is known when the join is planned, so a small one is broadcast and the rows of
    ``df`` are not shuffled; a large one is joined by shuffling as before. It pays when ``df`` is a
    stored table: a computed one would be computed a second time, where one plan shares its shuffles.
    By default a stored table's groups are counted by a sketch, in one pass over the key columns, and written
    first if they are few enough to be broadcast. The result is the same either way.
    """
    if written is None:
        written = is_stored(df) and few_keys(df, keys, len(stats))
    grouped = df.groupBy(*[as_col(k) for k in keys]).agg(*[c.alias(n) for n, c in stats.items()])
    return left_join_on(df, materialise(grouped, "stats") if written else grouped, keys)


def scale_to_max(
    df: DataFrame,
    index: str,
    value: str,
    keys: Sequence[str],
    out: str | None = None,
    written: bool | None = None,
) -> DataFrame:
    """Bring ``index`` onto the scale of ``value``: divide by max(index) / max(value) of the group.

    ``written``: see :func:`with_group_stats`.
    """
    maxima = {"__index_max": F.max(as_col(index)), "__value_max": F.max(as_col(value))}
    top = with_group_stats(df, keys, maxima, written)
    # try_divide: a group whose maximum is zero has no scale and yields NULL.
    factor = F.try_divide(as_col("__index_max"), as_col("__value_max"))
    return top.withColumn(out or index, F.try_divide(as_col(index), factor)).drop(
        "__index_max", "__value_max"
    )
