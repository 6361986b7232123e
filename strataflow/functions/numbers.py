"""Number casting, rounding and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import as_col


def safe_cast(c: Column | str, data_type: str) -> Column:
    """Cast that yields NULL instead of failing, in ANSI mode too."""
    return as_col(c).try_cast(data_type)


def half_even(c: Column | str, decimals: int) -> Column:
    """Round ties of the printed decimal to the even digit.

    The tie is one of the number as it is shown: 2.675 is a tie and becomes 2.68, though the stored
    binary number lies a little below it.
    """
    return F.bround(as_col(c), decimals)


def plain_number(c: Column | str, decimals: int) -> Column:
    """Shortest plain decimal text of a number rounded half-even: no exponent, no trailing zeros.

    A number too large for 38 digits keeps the text Spark gives it.
    """
    rounded = half_even(c, decimals)
    fixed = rounded.try_cast(f"decimal(38,{decimals})").cast("string")
    if decimals > 0:
        fixed = F.regexp_replace(fixed, r"\.?0+$", "")
    return F.coalesce(fixed, rounded.cast("string"))


def grouped_number(c: Column | str, decimals: int, na_text: str | None = None) -> Column:
    """Thousands-separated text. ``decimals=0`` floors first, as counts are displayed."""
    c = as_col(c)
    shown = F.format_number(F.floor(c), 0) if decimals == 0 else F.format_number(c, decimals)
    return shown if na_text is None else F.coalesce(shown, F.lit(na_text))


def rate_per(events: Column | str, person_time: Column | str, per: int = 100_000) -> Column:
    """Events per ``per`` units of person-time; NULL when no person-time was observed."""
    person_time = as_col(person_time)
    return F.when(person_time != 0, as_col(events) * F.lit(float(per)) / person_time)


def poisson_deviance_residual(y: Column | str, mu: Column | str) -> Column:
    """Signed square root of a row's Poisson deviance contribution."""
    y, mu = as_col(y).cast("double"), as_col(mu)
    # With r = (y - mu) / mu nothing nearly equal is subtracted, whatever the size of the counts.
    r = (y - mu) / mu
    series = r * r * (1 / 2 - r * (1 / 6 - r * (1 / 12 - r * (1 / 20 - r / 30))))
    unit = F.when(F.abs(r) < 1e-3, series).when(y == 0, F.lit(1.0)).otherwise((1 + r) * F.log1p(r) - r)
    return F.signum(y - mu) * F.sqrt(2.0 * mu * F.greatest(unit, F.lit(0.0)))
