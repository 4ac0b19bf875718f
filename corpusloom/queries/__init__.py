"""Queries over the tables of a folder, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from corpusloom.queries import evidence, groups, pipelines, reports, selection, splitting, text, vectors  # noqa: F401
from corpusloom.queries.registry import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    """Every registered query by name."""
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    """The SQL of those that have one."""
    return dict(SQL)
