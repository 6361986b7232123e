"""Row-wise projections. None of them moves data between partitions."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..functions.missing import as_col, matches


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """Fail early, with names, when columns are absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def drop_constant_settings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop settings that did not vary; an absent one is an error."""
    require_columns(df, cols)
    return df.drop(*cols)


def rename_display(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename ``{old: new}``; an absent old name is an error."""
    require_columns(df, list(mapping))
    return df.withColumnsRenamed(dict(mapping))


def relocate_columns(
    df: DataFrame, cols: Sequence[str], before: str | None = None, after: str | None = None
) -> DataFrame:
    """Move columns to the front, or before / after another column."""
    if before is not None and after is not None:
        raise ValueError("give before or after, not both")
    require_columns(df, [*cols, *[c for c in (before, after) if c is not None]])
    moved = list(cols)
    rest = [c for c in df.columns if c not in moved]
    if before in moved or after in moved:
        raise ValueError("the anchor column cannot be moved too")
    at = 0
    if before is not None:
        at = rest.index(before)
    elif after is not None:
        at = rest.index(after) + 1
    return df.select(*[as_col(c) for c in [*rest[:at], *moved, *rest[at:]]])


def calendar_parts(df: DataFrame, date_col: str) -> DataFrame:
    """Add ``year_index``, ``month_index`` and ``year_month``."""
    return df.withColumns(
        {
            "year_index": F.year(as_col(date_col)),
            "month_index": F.month(as_col(date_col)),
            "year_month": dates.year_month(date_col),
        }
    )


def date_parts(df: DataFrame, col: str) -> DataFrame:
    """Add ``year``, ``quarter``, ``month``, ``quarter_start`` and ``month_start``."""
    d = F.to_date(as_col(col))
    year, quarter = F.year(d), F.quarter(d)
    return df.withColumns(
        {
            "year": year,
            "quarter": quarter,
            "month": F.month(d),
            "quarter_start": dates.quarter_start(year, quarter),
            "month_start": dates.month_start(d),
        }
    )


def alias_recode(df: DataFrame, col: str, aliases: Mapping[str, str]) -> DataFrame:
    """Replace exact values; others pass through."""
    return df.withColumn(col, text.mapped(col, aliases))


def null_default(df: DataFrame, col: str, value) -> DataFrame:
    return df.withColumn(col, F.coalesce(as_col(col), F.lit(value)))


def label_recode(
    df: DataFrame, col: str, labels: Mapping[str, str], sort_col: str | None = None
) -> DataFrame:
    """Replace category codes by labels; unmapped codes pass through.

    Level order is the order of the codes, so ``sort_col`` simply keeps the code.
    The map is a plan literal: no join, nothing shipped per row.
    """
    if sort_col is not None:
        df = df.withColumn(sort_col, as_col(col))
    return df.withColumn(col, text.mapped(col, labels))


def regex_recode(df: DataFrame, col: str, pattern: str, value: str) -> DataFrame:
    """Set a constant where the pattern matches."""
    return df.withColumn(col, F.when(matches(col, pattern), F.lit(value)).otherwise(as_col(col)))


def unite_key(df: DataFrame, out: str, cols: Sequence[str], sep: str = "; ") -> DataFrame:
    """Add one text key made of several columns; the inputs stay."""
    return df.withColumn(out, text.united(cols, sep))


def variable_label(df: DataFrame, name: str, level: str) -> DataFrame:
    """``name`` becomes ``name: level`` where a level is present."""
    return df.withColumn(
        name,
        F.when(
            as_col(level).isNotNull(),
            F.concat(F.coalesce(as_col(name), F.lit("NA")), F.lit(": "), as_col(level)),
        ).otherwise(as_col(name)),
    )


def stamp(df: DataFrame, **constants) -> DataFrame:
    """Add constant columns."""
    return df.withColumns(
        {k: v if isinstance(v, Column) else F.lit(v) for k, v in constants.items()}
    )


def path_tag(
    df: DataFrame, path_col: str, rules: Sequence[tuple[str, str]], default: str, out: str = "time_at_risk"
) -> DataFrame:
    """Tag a row from its file path; the first matching rule wins."""
    return df.withColumn(out, text.first_match(path_col, rules, default))


def regex_flags(df: DataFrame, col: str, patterns: Mapping[str, str | tuple[str, bool]]) -> DataFrame:
    """One boolean column per name, from a pattern or a pair of a pattern and whether to negate it."""
    flags = {}
    for name, given in patterns.items():
        pattern, negate = (given, False) if isinstance(given, str) else given
        hit = matches(col, pattern)
        flags[name] = ~hit if negate else hit
    return df.withColumns(flags)


def regex_clean(df: DataFrame, col: str, rules: Sequence[tuple[str, str]], out: str | None = None) -> DataFrame:
    """Apply regex replacements in order."""
    return df.withColumn(out or col, text.substituted(col, rules))


def template_keys(df: DataFrame, col: str, out: str = "keys") -> DataFrame:
    """List the ``<key>`` names found in a text column."""
    return df.withColumn(out, text.template_keys(col))


def split_levels(df: DataFrame, col: str, out: str = "levels") -> DataFrame:
    """Split a combined level into its parts and count them."""
    parts = text.split_levels(col)
    return df.withColumns({out: parts, f"n_{out}": F.size(parts)})


def safe_cast(df: DataFrame, col: str, data_type: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, numbers.safe_cast(col, data_type))


def number_format(
    df: DataFrame, col: str, decimals: int, out: str | None = None, na_text: str | None = None
) -> DataFrame:
    """Thousands-separated text with 0 (floored), 1, 2 or 3 decimals."""
    return df.withColumn(out or col, numbers.grouped_number(col, decimals, na_text))


def rate_per_100k(
    df: DataFrame, y: str, pt: str, out: str = "rate", decimals: int | None = None
) -> DataFrame:
    rate = numbers.rate_per(y, pt)
    return df.withColumn(out, rate if decimals is None else numbers.half_even(rate, decimals))


def deviance_residuals(df: DataFrame, y: str, mu: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, numbers.poisson_deviance_residual(y, mu))
