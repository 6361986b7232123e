"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import as_col


def year_month(c: Column | str) -> Column:
    """``YYYY-MM`` text."""
    return F.date_format(as_col(c), "yyyy-MM")


def month_start(c: Column | str) -> Column:
    return F.trunc(as_col(c), "MM")


def quarter_start(year: Column | str, quarter: Column | str) -> Column:
    """First day of a quarter."""
    return F.make_date(as_col(year), as_col(quarter) * 3 - 2, F.lit(1))
