"""Queries registered for checking, the stand-in inputs they run on, and their SQL twins."""

from . import lake_queries, model_queries, shape_queries, tidy_queries  # noqa: F401  (registration)
from .registry import QUERIES
from .registry import SQL as SQL_TWINS

__all__ = ["SQL_TWINS", "all_queries"]


def all_queries():
    return dict(QUERIES)
