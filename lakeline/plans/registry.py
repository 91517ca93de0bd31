"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, folder) under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if f.__name__ in FOUND:
            raise ValueError(f"{f.__name__} is registered twice")
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def load_all() -> None:
    from lakeline.plans import access, cdc, events, history, ingest, metrics, models, retail  # noqa: F401


def queries() -> dict[str, Query]:
    load_all()
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    load_all()
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
