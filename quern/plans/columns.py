"""Picking input columns by exact name, whatever else the table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, matched by exact spelling, the first where a name repeats.

    Other columns may clash with these in case or with columns an operator adds: they are left behind, so no
    reference is ever ambiguous. Raises ValueError for a name that the table doesn't have.
    """
    have = df.columns
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {have}")
    if len({c.lower() for c in have}) == len(have):
        return df.select(*[F.col(f"`{n}`") for n in names])
    numbered = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return numbered.select(*[F.col(f"_c{have.index(n)}").alias(n) for n in names])
