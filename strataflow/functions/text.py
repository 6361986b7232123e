"""Text expressions: templates, name/level lists, keys."""

from __future__ import annotations

import re
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import as_col, matches, plain_text, text_or_na

# The two separators a combined name or level may use.
LEVEL_SEPARATOR = r" and | &&& "

_KEY = re.compile(r"<(.+?)>")


def template_key_list(template: str) -> list[str]:
    """Keys written as ``<key>`` in a template, in order, repeats included."""
    return _KEY.findall(template)


def template_keys(c: Column | str) -> Column:
    """The same for a column of templates."""
    return F.regexp_extract_all(as_col(c), F.lit(r"<(.+?)>"), F.lit(1))


def template_name(template: str) -> str:
    """Name given to an unnamed template: its text without the angle brackets."""
    return template.replace("<", "").replace(">", "")


def render_template(template: str, values: Mapping[str, Column | str]) -> Column:
    """Fill ``<key>`` slots with columns. The result is NULL when any slot is NULL."""
    parts: list[Column] = []
    end = 0
    for slot in _KEY.finditer(template):
        if slot.start() > end:
            parts.append(F.lit(template[end : slot.start()]))
        parts.append(plain_text(values[slot.group(1)]))
        end = slot.end()
    if end < len(template):
        parts.append(F.lit(template[end:]))
    return F.concat(*parts)


def united(cols: Sequence[str], sep: str = "; ") -> Column:
    """One text key from several columns, NULL parts shown as ``NA``."""
    return F.concat_ws(sep, *[text_or_na(c) for c in cols])


def split_levels(c: Column | str, separator: str = LEVEL_SEPARATOR) -> Column:
    """Parts of a combined name or level."""
    return F.split(as_col(c), separator)


def first_match(c: Column | str, rules: Iterable[tuple[str, str]], default: str) -> Column:
    """Tag of the first rule whose pattern matches."""
    tag = F.lit(default)
    for pattern, value in reversed(list(rules)):
        tag = F.when(matches(c, pattern), F.lit(value)).otherwise(tag)
    return tag


def substituted(c: Column | str, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply regex replacements one after another."""
    out = as_col(c)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def mapped(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Exact-value recode by a literal map; values not in it pass through."""
    c = as_col(c)
    if not mapping:
        return c
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)
