"""Where queries are registered, by name and with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with DuckDB SQL for the same rows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r(column: str | Column, digits: int = 3) -> Column:
    """A sum of doubles, rounded, because its last digits depend on the order; negative zero is zero."""
    name = column if isinstance(column, str) else None
    out = F.round(F.col(column) if name else column, digits) + F.lit(0.0)
    return out.alias(name) if name else out
