"""Names of all queries: the function that plans each and, where SQL can say it, the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    """Enter a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tamnan import plans  # noqa: F401  (registers)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tamnan import plans  # noqa: F401

    return dict(_SQL)
