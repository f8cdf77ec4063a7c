"""All registered queries of the library's own operators, and their DuckDB twins."""

from __future__ import annotations

from placeprint.plans import evaluation, files, flows, learning, scoring, sets, signals, streams  # noqa: F401  they register
from placeprint.plans.registry import ALL, Query


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
