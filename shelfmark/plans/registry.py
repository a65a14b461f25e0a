"""The registered queries: a Spark callable each, and the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, big: tuple[str, ...] | list[str] = ()) -> Callable[[Query], Query]:
    """Register a query; ``big`` names SQL columns to read as 64-bit integers, as Spark gives them."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in big)
            SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({sql}) AS q" if big else sql
        return query

    return add
