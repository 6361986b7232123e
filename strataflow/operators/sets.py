"""Unions and presentation order."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import as_col
from .joins import with_group_stats


def ragged_union(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column a frame lacks is NULL there. At least one frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def bag_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two frames of the same columns, duplicates kept."""
    return a.unionByName(b)


def template_position(name_col: str, names: Sequence[str]) -> Column:
    """Position 1..n of a template name; n + 1 for any other name."""
    position = F.lit(len(names) + 1)
    for i in range(len(names), 0, -1):
        position = F.when(as_col(name_col) == F.lit(names[i - 1]), F.lit(i)).otherwise(position)
    return position


def template_order(
    df: DataFrame,
    names: Sequence[str],
    order: str,
    name_col: str = "estimate_name",
    written: bool | None = None,
) -> DataFrame:
    """Add ``format_id`` and ``name_first_id``, the keys to sort a group's rows by.

    Template names take their position 1..n; every other name comes after them, in the order of
    first appearance, which is what ``name_first_id`` orders by. ``written``: see
    :func:`with_group_stats`.
    """
    first = with_group_stats(df, [name_col], {"name_first_id": F.min(as_col(order))}, written)
    return first.withColumn("format_id", template_position(name_col, names))
