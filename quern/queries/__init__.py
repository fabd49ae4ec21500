"""Registered queries by operator id, each with the SQL that its result is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quern.binding import Store

QUERIES: dict[str, Callable[[Store], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of the store under `name`."""

    def add(f: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
