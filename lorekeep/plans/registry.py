"""All queries of the text-memory operators and their SQL."""

from __future__ import annotations

from . import queries_files, queries_joins, queries_state, queries_text


def _modules():
    return (queries_text, queries_joins, queries_state, queries_files)


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
