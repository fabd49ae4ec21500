"""Running totals over groups of any size without a task that sees a whole group.

Rows are ordered by a 64-bit hash inside their group. The high bits of the hash name a bucket of about
`bucket_rows` rows; a window orders one bucket at a time, and bucket totals are summed in two further levels, so
the largest window holds about the square root of the number of buckets.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one bucket holds on average at most.
BUCKET_ROWS = 1024


def bucket_bits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Bits of the hash that spread `rows` rows over buckets of about `bucket_rows`."""
    return max(1, min(40, ceil(log2(max(2, rows / bucket_rows)))))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return cond


def running_total(df: DataFrame, group: list[str], order: str, ties: list[str], value: Column, out: str, bits: int) -> DataFrame:
    """Adds `out`: the sum of `value` over earlier rows of the same group, as `running_totals` does."""
    return running_totals(df, group, order, ties, {out: value}, bits)


def running_totals(df: DataFrame, group: list[str], order: str, ties: list[str], values: dict[str, Column], bits: int) -> DataFrame:
    """Adds for each name in `values` the sum of its column over earlier rows of the same group.

    Earlier means smaller (unsigned `order`, then `ties`). `order` names a long column that spreads evenly, such
    as a hash; equal values of it share a bucket, so callers hash in whatever tells repeated rows apart.
    """
    at = {f"_v{i}": c.cast("long") for i, c in enumerate(values.values())}
    bucket = F.shiftrightunsigned(F.col(order), 64 - bits)
    rows = df.withColumns({**at, "_b": bucket})
    inner = W.partitionBy(*group, "_b").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"_in{v}": F.sum(v).over(inner) for v in at})

    half = bits // 2
    buckets = df.select(*group, bucket.alias("_b"), *[c.alias(v) for v, c in at.items()])
    buckets = buckets.groupBy(*group, "_b").agg(*[F.sum(v).alias(v) for v in at]).withColumn("_s", F.shiftright("_b", half))
    mid = W.partitionBy(*group, "_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = buckets.withColumns({f"_mid{v}": F.coalesce(F.sum(v).over(mid), F.lit(0)) for v in at})
    top = buckets.groupBy(*group, "_s").agg(*[F.sum(v).alias(v) for v in at])
    high = (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    top = top.withColumns({f"_top{v}": F.coalesce(F.sum(v).over(high), F.lit(0)) for v in at})
    top = top.select(*[F.col(k).alias(f"_r_{k}") for k in [*group, "_s"]], *[f"_top{v}" for v in at])
    before = before.join(top, _same(before, top, [*group, "_s"]))
    before = before.select(*[F.col(k).alias(f"_r_{k}") for k in [*group, "_b"]], *[(F.col(f"_mid{v}") + F.col(f"_top{v}")).alias(f"_off{v}") for v in at])

    joined = rows.join(before, _same(rows, before, [*group, "_b"]))
    return joined.select(*df.columns, *[(F.coalesce(F.col(f"_in{v}"), F.lit(0)) + F.col(f"_off{v}")).alias(out) for out, v in zip(values, at)])
