"""Telling rows apart, the same way every time a plan runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.columns import pick
from quern.plans.lineage import cut


def numbered(df: DataFrame, *columns: str, name: str = "_row") -> DataFrame:
    """The named columns and a long that tells rows apart and stays the same when the plan runs again.

    A row of a file is known by the file and its place there, however the scan is split. Rows of any other plan are
    checkpointed and numbered, since ids that depend on partitions change when executors come and go.
    """
    have = df.columns
    try:
        wide = df.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        return cut(pick(df, *columns)).withColumn(name, F.monotonically_increasing_id())
    if missing := [c for c in columns if c not in have]:
        raise ValueError(f"missing columns {missing}; the table has {have}")
    apart = wide.toDF(*[f"_c{i}" for i in range(len(have) + 1)])
    return apart.select(*[F.col(f"_c{have.index(c)}").alias(c) for c in columns], F.col(f"_c{len(have)}").alias(name))
