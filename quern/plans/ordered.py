"""Running values over groups of any size, in an order, without a task that holds a group.

Rows are dealt by ranges of the group and the order, each range is a table part of its own, and a window works on one group in
one part. What a part passes on (counts, sums, its last value) is a row for each group and part; a window over those rows
gives what comes before each part, and rows take it by a join on group and part. Only the number of parts is in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.plans.lineage import written


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def _parts(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows with the number of their range, written, so that the numbers stay."""
    return written(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))


def _before(parts: DataFrame, group: list[str], made: dict[str, Column]) -> DataFrame:
    """_g0, ..., _at and for each name a value of the earlier parts of the group."""
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    own = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    return parts.select(*own, F.col("_part").alias("_at"), *[value.over(earlier).alias(name) for name, value in made.items()])


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], count: str | None = None) -> DataFrame:
    """Adds the sum of each column in `sums` over the group's rows up to this one, and with `count` their number.

    `order` must tell the rows of a group apart (else rows that it doesn't part come in any order). Nulls add nothing; nulls in
    the order come first. An empty group list is one group.
    """
    values = {f"_v{i}": c for i, c in enumerate(sums.values())} | {"_n": F.lit(1).cast("long")}
    rows = _parts(df.withColumns(values), group, order)
    totals = rows.groupBy(*group, "_part").agg(*[F.sum(v).alias(v) for v in values])
    before = _before(totals, group, {f"_b{v}": F.sum(v) for v in values})
    inside = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"_in{v}": F.sum(v).over(inside) for v in values})
    joined = rows.join(before, _same(rows, before, [*((g, f"_g{i}") for i, g in enumerate(group)), ("_part", "_at")]))
    # null until a value is there, as a window's sum is
    up_to = lambda v: F.when(F.col(f"_in{v}").isNull(), F.col(f"_b{v}")).when(F.col(f"_b{v}").isNull(), F.col(f"_in{v}")).otherwise(F.col(f"_in{v}") + F.col(f"_b{v}"))
    out = [up_to(v).alias(name) for name, v in zip(sums, values)]
    return joined.select(*df.columns, *out, *([up_to("_n").alias(count)] if count else []))


def last_values(df: DataFrame, group: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the last value that isn't null among the group's rows up to this one."""
    rows = _parts(df.withColumn("_v", value), group, order)
    totals = rows.groupBy(*group, "_part").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_v"))
    before = _before(totals, group, {"_b": F.last("_v", ignorenulls=True)})
    inside = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    joined = rows.join(before, _same(rows, before, [*((g, f"_g{i}") for i, g in enumerate(group)), ("_part", "_at")]))
    return joined.select(*df.columns, F.coalesce("_in", "_b").alias(out))


def groups_frame(df: DataFrame, group: list[str], order: str, value: Column, preceding: int, total: str, count: str, rank: str) -> DataFrame:
    """Adds sum and number of rows over the peers (equal `order`) of this row and the `preceding` groups of peers before, and
    the dense rank: a GROUPS frame. Peers are added up first, so any number of them is one row where the order matters."""
    peers = df.groupBy(*group, order).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c"))
    some = F.coalesce(F.col("_s").isNotNull().cast("long"), F.lit(0))
    ranked = written(running(peers, group, [order], {"_cs": F.coalesce("_s", F.lit(0)), "_cc": F.col("_c"), "_some": some}, count="_rank"))
    back = ranked.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], (F.col("_rank") + preceding + 1).alias("_at"), *[F.col(c).alias(f"_p{c}") for c in ("_cs", "_cc", "_some")])
    joined = ranked.join(back, _same(ranked, back, [*((g, f"_g{i}") for i, g in enumerate(group)), ("_rank", "_at")]), "left")
    inside = lambda c: F.col(c) - F.coalesce(f"_p{c}", F.lit(0))
    framed = joined.select(
        *[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], F.col(order).alias("_o"), F.when(inside("_some") > 0, inside("_cs")).alias(total), inside("_cc").cast("long").alias(count), F.col("_rank").alias(rank)
    )
    met = df.join(framed, _same(df, framed, [*((g, f"_k{i}") for i, g in enumerate(group)), (order, "_o")]))
    return met.select(*[df[c] for c in df.columns], total, count, rank)
