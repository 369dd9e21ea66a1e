"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers a function under its name; ctes go before the SQL."""

    def put(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f.__name__)
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"with {', '.join(ctes)}" + " " * (not sql.startswith(",")) if ctes else "") + sql
        return f

    return put
