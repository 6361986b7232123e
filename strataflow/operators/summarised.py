"""Reshaping of summarised results: long (name, level, estimate) rows into display rows."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.missing import as_col, one_of
from .joins import left_join_on
from .levels import combined_levels
from .projections import require_columns
from .sets import bag_union, template_position
from .sets import template_order as template_rank

# The columns that describe one estimate, and the name every level pair may carry
# when it does not stratify.
ESTIMATE_COLUMNS = ("estimate_name", "estimate_type", "estimate_value")
OVERALL = "overall"


@dataclass(frozen=True)
class _Template:
    position: int
    name: str
    text: str
    keys: tuple[str, ...]


def _templates(templates: Mapping[str, str] | Sequence[str]) -> list[_Template]:
    pairs = templates.items() if isinstance(templates, Mapping) else [("", t) for t in templates]
    return [
        _Template(i, name or text.template_name(t), t, tuple(text.template_key_list(t)))
        for i, (name, t) in enumerate(pairs, start=1)
    ]


def _applicable(
    df: DataFrame, templates: Sequence[_Template], known_names: Sequence[str] | None
) -> list[_Template]:
    """Templates whose keys all occur in the data; the others are named in a warning."""
    if known_names is None:
        keys = sorted({k for t in templates for k in t.keys})
        found = df.filter(one_of("estimate_name", keys)).select("estimate_name").distinct()
        known_names = [r[0] for r in found.collect()]
    out = []
    for t in templates:
        if not t.keys:
            warnings.warn(f"template without a <key>: {t.text}")
        elif not set(t.keys) <= set(known_names):
            warnings.warn(f"template with keys the data lacks: {t.text}")
        else:
            out.append(t)
    return out


def _applies(t: _Template) -> Column:
    return as_col(f"__applies{t.position}")


def _settle(
    df: DataFrame, ids: Sequence[str], templates: Sequence[_Template], order: str | None
) -> DataFrame:
    """One row per group: the value of each key and which templates apply."""
    aggs: list[Column] = []
    for k in sorted({k for t in templates for k in t.keys}):
        here = as_col("estimate_name") == F.lit(k)
        aggs.append(F.count(F.when(here, F.lit(1))).alias(f"__n_{k}"))
        aggs.append(F.max(F.when(here, as_col("estimate_value"))).alias(f"__v_{k}"))
    if order is not None:
        aggs.append(F.min(as_col(order)).alias("group_id"))
    else:
        # Only the smallest id of a group depends on its other rows.
        df = df.filter(one_of("estimate_name", {k for t in templates for k in t.keys}))
    grouped = df.groupBy(*[as_col(c) for c in ids]).agg(*aggs)
    for i, t in enumerate(templates):
        # Each key is there exactly once, and no earlier template has taken it.
        applies = F.lit(len(t.keys) == len(set(t.keys)))
        for k in t.keys:
            applies = applies & (as_col(f"__n_{k}") == 1)
        for earlier in templates[:i]:
            if set(earlier.keys) & set(t.keys):
                applies = applies & ~_applies(earlier)
        grouped = grouped.withColumn(f"__applies{t.position}", applies)
    return grouped


def _formatted_rows(settled: DataFrame, templates: Sequence[_Template]) -> DataFrame:
    """The display rows of every group."""
    rows = []
    for i, t in enumerate(templates):
        shown = _applies(t)
        for later in templates[i + 1 :]:
            # A later template that takes a key of the same name removes this row as well.
            if t.name in later.keys:
                shown = shown & ~_applies(later)
        row = F.struct(
            F.lit(t.name).alias("estimate_name"),
            F.lit("character").alias("estimate_type"),
            text.render_template(t.text, {k: f"__v_{k}" for k in t.keys}).alias("estimate_value"),
            F.lit(t.position).alias("format_id"),
        )
        rows.append(F.when(shown, row))
    return settled.select("*", F.inline(F.array_compact(F.array(*rows)))).withColumn(
        "name_first_id", F.lit(None).cast("long")
    )


def _taken_names(templates: Sequence[_Template]) -> Column:
    """Estimate names a group has lost to its templates."""
    taken = [F.when(_applies(t), F.lit(k)) for t in templates for k in dict.fromkeys(t.keys)]
    return F.array_compact(F.array(*taken))


def format_estimates(
    df: DataFrame,
    templates: Mapping[str, str] | Sequence[str] | None,
    keep_unformatted: bool = True,
    template_order: bool = True,
    order: str | None = None,
    known_names: Sequence[str] | None = None,
) -> DataFrame:
    """Merge the estimates of a group into display text, one row per applicable template.

    A group is all columns but the estimate ones. Templates are tried in turn; one applies to a
    group that still holds each of its keys exactly once, and takes those rows away from later
    templates. Text is NULL when a key's value is NULL.

    All templates are settled in one aggregation: it counts each key per group, and "already taken"
    is an expression over those counts. Only ``keep_unformatted`` needs a second look at the input.

    With ``template_order`` the output carries ``format_id``, the position of its template. ``order``
    names a stable row id; with it come ``group_id`` (smallest id of the group) and
    ``name_first_id`` too, and sorting by the three, left to the sink, gives the display order.
    ``known_names`` spares the distinct job behind the warning about keys the data lacks.
    """
    if not templates:
        return df
    require_columns(df, ESTIMATE_COLUMNS)
    listed = _templates(templates)
    ids = [c for c in df.columns if c not in (*ESTIMATE_COLUMNS, order)]
    ranks = ["format_id"] if order is None else ["group_id", "format_id", "name_first_id"]
    columns = [as_col(c) for c in [*[c for c in df.columns if c != order], *ranks]]

    usable = _applicable(df, listed, known_names)
    parts = []
    if usable:
        settled = _settle(df, ids, usable, order)
        parts.append(_formatted_rows(settled, usable).select(*columns))
    if keep_unformatted or not usable:
        left = df if keep_unformatted else df.filter(F.lit(False))
        if usable:
            # One join on the keys of the aggregation; a group's taken names come as one list.
            taken = settled.select(*[as_col(c) for c in ids], _taken_names(usable).alias("__taken"))
            gone = F.array_contains(as_col("__taken"), as_col("estimate_name"))
            left = left_join_on(left, taken, ids).filter(~F.coalesce(gone, F.lit(False))).drop("__taken")
        names = [t.name for t in listed]
        if order is None:
            left = left.withColumn("format_id", template_position("estimate_name", names))
        else:
            left = template_rank(group_id_of(left, df, ids, order), names, order)
            left = left.withColumn("name_first_id", as_col("name_first_id").cast("long"))
        parts.append(left.select(*columns))
    out = reduce(bag_union, parts)
    return out if template_order else out.drop("format_id", "name_first_id")


def group_id_of(rows: DataFrame, whole: DataFrame, ids: Sequence[str], order: str) -> DataFrame:
    """Smallest id, over the whole input, of the group each row belongs to."""
    first = whole.groupBy(*[as_col(c) for c in ids]).agg(F.min(as_col(order)).alias("group_id"))
    return left_join_on(rows, first, ids)


def render_template(template: str, cols: Mapping[str, str]) -> Column:
    """Column that fills ``<key>`` slots; NULL when any slot is NULL."""
    return text.render_template(template, cols)


def _distinct_parts(df: DataFrame, names: Sequence[str], separator: str = text.LEVEL_SEPARATOR) -> dict[str, list[str]]:
    """Distinct part names, other than ``overall``, of several name columns: the columns their
    splits will create. One pass over the input for all of them."""
    found = F.inline(
        F.array(*[F.struct(F.lit(c).alias("c"), as_col(c).alias("n")) for c in names])
    )
    rows = (
        df.select(found)
        .distinct()
        .select("c", F.explode(text.split_levels("n", separator)).alias("part"))
        .distinct()
        .collect()
    )
    return {c: sorted(r["part"] for r in rows if r["c"] == c and r["part"] != OVERALL) for c in names}


def split_name_level(
    df: DataFrame,
    name: str,
    level: str,
    keep: bool = False,
    fill: str | None = OVERALL,
    columns: Sequence[str] | None = None,
    separator: str = text.LEVEL_SEPARATOR,
    known: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One column per distinct part of ``name``, holding the part of ``level`` at the same place.

    Names and levels of different length fail the job. Rows without a part get ``fill``. The new
    columns take the place of the pair. ``columns`` names the parts to expect and spares the
    distinct job that finds them; a part it does not name fails the job. ``separator`` is the pattern
    between parts; give a narrower one where levels hold the word ``and``. Or give ``known``, levels by
    name, an empty mapping too: levels with too many parts are then read by the known ones and
    those seen elsewhere in the table (:func:`.levels.combined_levels`).
    """
    require_columns(df, [name, level])
    parts = list(columns) if columns is not None else _distinct_parts(df, [name], separator)[name]
    # Column names ignore case.
    folded = {p.lower() for p in parts}
    given = df.columns
    clash = [c for c in given if c.lower() in folded]
    if clash:
        warnings.warn(f"columns replaced by parts of {name}: {', '.join(clash)}")

    names, levels = text.split_levels(name, separator), text.split_levels(level, separator)
    if known is not None:
        read = combined_levels(df, name, level, known, separator)
        read = read.select(as_col("name").alias("__name"), as_col("level").alias("__level"), as_col("parts").alias("__parts"))
        df = df.join(read, (as_col(name) == as_col("__name")) & (as_col(level) == as_col("__level")), "left")
        levels = F.coalesce(as_col("__parts"), levels)
    own = F.array_remove(names, OVERALL)
    checked = (
        F.when(
            F.coalesce(F.size(names), F.lit(1)) != F.coalesce(F.size(levels), F.lit(1)),
            F.raise_error(F.lit(f"{name} and {level} have different numbers of parts")),
        )
        .when(
            F.size(F.array_distinct(own)) < F.size(own),
            F.raise_error(F.lit(f"{name} names a part twice")),
        )
        .when(
            F.size(F.array_except(own, F.array(*[F.lit(p) for p in parts]).cast("array<string>"))) > 0,
            F.raise_error(F.concat(F.lit(f"a part of {name} was not asked for: "), as_col(name))),
        )
        .otherwise(names)
    )

    def value(part: str) -> Column:
        # array_position is 0 when absent; a NULL index makes the lookup NULL.
        at = F.nullif(F.array_position(checked, F.lit(part)), F.lit(0)).cast("int")
        found = F.try_element_at(levels, at)
        return found if fill is None else F.coalesce(found, F.lit(fill))

    new = [value(p).alias(p) for p in parts]
    out: list[Column] = []
    for c in given:
        if c == name:
            if keep:
                out += [as_col(name), as_col(level)]
            out += new
        elif c == level or c.lower() in folded:
            continue
        else:
            out.append(as_col(c))
    if not parts:
        # No new column evaluates the length check then; a predicate that always holds does.
        df = df.filter(F.coalesce(F.size(checked), F.lit(0)) >= 0)
    return df.select(*out)


def split_group(df, keep=False, fill=OVERALL, columns=None, separator=text.LEVEL_SEPARATOR, known=None) -> DataFrame:
    return split_name_level(df, "group_name", "group_level", keep, fill, columns, separator, known)


def split_strata(df, keep=False, fill=OVERALL, columns=None, separator=text.LEVEL_SEPARATOR, known=None) -> DataFrame:
    return split_name_level(df, "strata_name", "strata_level", keep, fill, columns, separator, known)


def split_additional(df, keep=False, fill=OVERALL, columns=None, separator=text.LEVEL_SEPARATOR, known=None) -> DataFrame:
    return split_name_level(df, "additional_name", "additional_level", keep, fill, columns, separator, known)


def split_all(
    df: DataFrame,
    keep: bool = False,
    fill: str | None = OVERALL,
    columns: Mapping[str, Sequence[str]] | None = None,
    separator: str = text.LEVEL_SEPARATOR,
    known: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Split the group, strata and additional pairs.

    ``columns`` may list the expected parts under ``group``, ``strata`` and ``additional``. ``known``: see
    :func:`split_name_level`.
    """
    columns = dict(columns or {})
    open_pairs = [p for p in ("group", "strata", "additional") if columns.get(p) is None]
    if open_pairs:
        found = _distinct_parts(df, [f"{p}_name" for p in open_pairs], separator)
        columns |= {p: found[f"{p}_name"] for p in open_pairs}
    df = split_group(df, keep, fill, columns.get("group"), separator, known)
    df = split_strata(df, keep, fill, columns.get("strata"), separator, known)
    return split_additional(df, keep, fill, columns.get("additional"), separator, known)
