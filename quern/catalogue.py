"""All registered queries outside the training-data package, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.binding import Store
from quern.queries import QUERIES, SQL
from quern.queries import answers as _answers  # noqa: F401  registers
from quern.queries import metadata as _metadata  # noqa: F401  registers
from quern.queries import more as _more  # noqa: F401  registers
from quern.queries import parts as _parts  # noqa: F401  registers
from quern.queries import reading as _reading  # noqa: F401  registers
from quern.queries import relations as _relations  # noqa: F401  registers


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["f00_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Store(spark, sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
