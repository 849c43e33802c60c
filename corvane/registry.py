"""All registered queries of the library and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "coverage_by_operator"


def register(name: str, sql: str | None = None):
    """Decorator: adds a query (spark, sf_dir) -> DataFrame, with its SQL."""

    def add(query):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return add


def load() -> None:
    """Imports all modules that register queries."""
    import importlib
    import pkgutil

    from . import queries

    for module in pkgutil.iter_modules(queries.__path__):
        importlib.import_module(f"{queries.__name__}.{module.name}")
