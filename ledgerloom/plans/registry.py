"""The registered queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` may name the CTEs of ``fixture_sql``."""
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            from .fixture_sql import with_ctes

            ORACLE[name] = with_ctes(sql)
        return f
    return keep
