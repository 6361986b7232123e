"""Sums of doubles that do not depend on the order of rows, tasks or partial sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number is cut into its whole part and four pieces of 26 bits after the binary point.
_BITS = 26
_MASK = (1 << _BITS) - 1
_LARGEST = f"{1 << 52}D"


def _let(value: str, name: str, use: str) -> str:
    """``use`` of a value that is written, and computed, once under a name."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _pieces(x: str) -> list[str]:
    """Whole numbers that make up ``x``; nothing above 2^-104 is rounded."""
    scaled = f"(({x} - cast(cast({x} as bigint) as double)) * {_LARGEST})"
    upper = f"cast({scaled} as bigint)"
    lower = f"cast(({scaled} - cast({upper} as double)) * {_LARGEST} as bigint)"
    return [f"cast({x} as bigint)", *(p for half in (upper, lower) for p in (f"shiftright({half}, {_BITS})", f"{half} & {_MASK}L"))]


def _carried(sums: str) -> str:
    """The same number with pieces from 0 to 2^26; the whole part has the sign."""
    out = [f"{sums}[{n}]" for n in range(5)]
    for n in (4, 3, 2, 1):
        out[n - 1] = f"({out[n - 1]} + shiftright({out[n]}, {_BITS}))"
    return f"array({out[0]}, {', '.join(f'{piece} & {_MASK}L' for piece in out[1:])})"


def _joined(sums: str) -> str:
    """The double next to the number, from pieces of one sign, the smallest first."""
    total = f"cast({sums}[4] as double)"
    for n in (3, 2, 1, 0):
        total = f"(cast({sums}[{n}] as double) + {total} / {1 << _BITS}D)"
    return total


def exact_sum(expression: str) -> Column:
    """Sum of a double, given as SQL, the same to the last bit whatever the partitioning; NULL if all inputs are.

    Every number is cut into whole numbers, whose sums are exact, and the sums are put together once.
    Digits below 2^-104 are cut off. Numbers of 2^52 and more, infinite ones and NaN are added as
    doubles. A sum of whole parts beyond 64 bits fails. It is one SQL text, since built column by column
    it would take longer to write than to run.
    """
    x = f"cast({expression} as double)"
    plain = f"abs({x}) < {_LARGEST}"  # not so for NaN, which is larger than all
    sums = ", ".join(f"sum({piece})" for piece in _pieces(f"if({plain}, {x}, NULL)"))
    opposite = _let("transform(c, p -> -p)", "n", _let(_carried("n"), "m", f"-{_joined('m')}"))
    total = _let(f"array({sums})", "s", _let(_carried("s"), "c", f"if(c[0] < 0, {opposite}, {_joined('c')})"))
    rest = f"sum(if({plain}, NULL, {x}))"
    both = _let(f"struct({total} AS exact, {rest} AS rest)", "b", "if(b.rest IS NULL, b.exact, coalesce(b.exact, 0D) + b.rest)")
    return F.expr(both)


def quoted(name: str) -> str:
    """A column name as SQL."""
    return "`" + name.replace("`", "``") + "`"
