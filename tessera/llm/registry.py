"""The queries of this package, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from tessera.llm import charfold_queries, conversations_queries, leaks_queries, mixing_queries, neighbors_queries, triejoin_queries

_MODULES = [triejoin_queries, conversations_queries, neighbors_queries, leaks_queries, charfold_queries, mixing_queries]


def queries() -> dict[str, Callable]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
