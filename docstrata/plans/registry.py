"""Name -> (query, DuckDB SQL or None) for every registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator that adds a query and its oracle under one name."""

    def add(f: Query) -> Query:
        if name in _FOUND:
            raise ValueError(f"{name} is registered twice")
        _FOUND[name] = (f, sql)
        return f

    return add


def _load() -> None:
    from docstrata.plans import audit, catalog, dialogue, documents, evidence, extraction, forms, graph, items, replies, retrieval, rules, streams  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _FOUND.items() if s}
