"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.plans.lineage import cut


def percentiles(df: DataFrame, group: list[str], value: str, asked: dict[str, float]) -> DataFrame:
    """The group columns and a double for each name in `asked`: the value at that share of the ranks, linear in between.

    Equal values are counted first; the counts are split by ranges of group and value, so that no task holds a group.
    Nulls are left out; a group of nothing else has no row.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut(counted.repartitionByRange(*group, "_v").withColumn("_p", F.spark_partition_id()))
    # a row for each group in each range
    parts = ranged.groupBy(*group, "_p").agg(F.sum("_n").alias("_t"))
    earlier = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).withColumn("_all", F.sum("_t").over(W.partitionBy(*group)))
    parts = parts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_p").alias("_q"), "_before", "_all")
    same = F.col("_p") == F.col("_q")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = W.partitionBy(*group, "_p").orderBy("_v")
    rows = ranged.join(parts, same)
    rows = rows.withColumn("_end", F.col("_before") + F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("_n"))
    out = []
    for name, share in asked.items():
        at = (F.col("_all") - 1) * F.lit(float(share))
        low, high = F.floor(at), F.ceil(at)
        holds = lambda rank: (F.col("_start") <= rank) & (rank < F.col("_end"))
        below = F.max(F.when(holds(low), F.col("_v")))
        above = F.max(F.when(holds(high), F.col("_v")))
        part = F.max(at - low)
        out.append((below + (above - below) * part).alias(name))
    return rows.groupBy(*group).agg(*out)
