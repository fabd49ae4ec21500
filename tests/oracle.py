"""Compares a query with its SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"


def duck(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(tuple(r[i]) if isinstance(r[i], list) else r[i] for i in order) for r in rows)


def same(df, sql: str, sf: str = SF) -> None:
    relation = duck(sf).sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(relation.columns, relation.fetchall())
