"""Registration of queries and assembly of their SQL twins."""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .views_sql import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name the stand-in views of ``views_sql``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return add


def _mentioned(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    """Put the definitions of all views a statement needs in front of it."""
    needed: set[str] = set()
    todo = _mentioned(sql)
    while todo:
        v = todo.pop()
        if v not in needed:
            needed.add(v)
            todo += _mentioned(VIEWS[v])
    definitions = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in VIEWS if v in needed)
    body = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    recursive = "RECURSIVE " if own and own.group(1) else ""
    if not definitions:
        return body
    if own:
        return f"WITH {recursive}{definitions},\n{body[own.end():]}"
    return f"WITH {definitions}\n{body}"
