"""Where queries are registered, each with the DuckDB SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Registers a function by its name. uses: the derived views that the SQL reads, space-separated."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [views.SQL[v] for v in uses.split()]
            body = sql.strip()
            if parts:
                body = "WITH " + ",\n".join(parts) + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
            SQL[f.__name__] = body
        return f

    return add
