"""Where queries register themselves with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Name -> (query, SQL or None).
ALL: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    """Decorator that registers a query and its SQL twin."""

    def put(query: Query) -> Query:
        if name in ALL:
            raise ValueError(f"{name} is registered twice")
        ALL[name] = (query, sql)
        return query

    return put
