"""Registered queries: a DataFrame function and, where SQL can say the same, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.adapters import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None, views: str = "") -> None:
    """``views`` names the adapters that the SQL reads; ``sql`` goes on after their WITH list or begins with more of it (", x AS (...)")."""
    QUERIES[name] = run
    if sql is not None:
        used = [v for v in views.split() if v]
        if not used:
            ORACLES[name] = sql.strip()
            return
        head = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
        ORACLES[name] = head + ",\n".join(f"{v} AS ({SQL[v]})" for v in used) + sql.replace("RECURSIVE", "").rstrip()
