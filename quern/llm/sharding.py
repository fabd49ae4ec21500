"""Two-pass external shuffle.

Pass one scatters records over memory-sized buckets by a seeded hash; pass two reads one bucket at a time, shuffles
it with Fisher-Yates and lays the buckets end to end. The place of a record in that order gives its shard and slot,
so shard counts differ by one at most (the `rows` law).

Defined cases: null texts count as empty in sizes and are written as null; a null id is an ordinary value; repeated
rows are separate records (a row's place in its file is hashed too, so a third of all rows may be equal); an empty
table gives no rows; columns that aren't asked for are left behind, whatever their names.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.plans.prefix import running_total
from quern.plans.rows import numbered

#: Memory-sized: the bytes of text that a bucket holds on average.
BUCKET_BYTES = 8 << 20


def _fisher_yates(seed: int):
    def shuffle(table: pa.Table) -> pa.Table:
        """One bucket. Rows arrive in any order, so they are first put in the order of their keys."""
        order = np.lexsort((table.column("_row").to_numpy(), table.column("_key").to_numpy()))
        bucket = table.column("_bucket")[0].as_py()
        # permutation() is numpy's Fisher-Yates; the seed depends on the bucket alone, so a lost task repeats it
        order = order[np.random.default_rng([seed, bucket]).permutation(len(order))]
        at = table.column("_first")[0].as_py() + np.arange(len(order), dtype=np.int64)
        table = table.take(pa.array(order)).drop_columns(["_row", "_key", "_bucket", "_first"])
        return table.append_column("_at", pa.array(at))

    return shuffle


def shuffle_into_shards(records: DataFrame, shards: int, columns: list[str], key: str = "doc_id", text: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`columns` of every record plus `shard` (int, from 0) and `slot` (long, gapless from 0 in each shard).

    Runs one small job for the number of records and bytes. `columns` may not name shard or slot.
    """
    if {"shard", "slot"} & {c.lower() for c in columns}:
        raise ValueError("columns may not hold shard or slot")
    rows = numbered(records, *dict.fromkeys([*columns, key, text]))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    buckets = max(1, ceil((size or 0) / bucket_bytes))

    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), F.col(key), F.col("_row")))
    rows = rows.withColumn("_bucket", F.pmod(F.col("_key"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = running_total(counts.withColumn("_h", F.shiftleft(F.col("_bucket").cast("long"), 32)), [], "_h", [], F.col("_n"), "_first", 24)
    first = first.select(F.col("_bucket").alias("_b"), "_first")

    kept = list(dict.fromkeys(columns))
    # the offsets join by the bucket that the records are dealt by anyway, so these move once
    rows = rows.join(first, F.col("_bucket") == F.col("_b")).select(*kept, "_row", "_key", "_bucket", "_first")
    types = dict(rows.dtypes)
    out = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "_at long"])
    placed = rows.groupBy("_bucket").applyInArrow(_fisher_yates(seed), out)
    return placed.select(*kept, *place_in_shards("_at", n, shards))


def place_in_shards(at: str, rows: int, shards: int):
    """Shard and slot of global place `at`: the first rows % shards shards hold one row more."""
    small, more = divmod(rows, shards)
    cut = more * (small + 1)
    width = max(1, small)
    shard = F.when(F.col(at) < cut, F.expr(f"`{at}` div {small + 1}")).otherwise(F.expr(f"{more} + (`{at}` - {cut}) div {width}"))
    slot = F.when(F.col(at) < cut, F.col(at) % (small + 1)).otherwise((F.col(at) - cut) % width)
    return shard.cast("int").alias("shard"), slot.cast("long").alias("slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes a folder for each shard, with a file of every task that has rows of it, in slot order.

    A bucket's places follow one another, so it is in one shard or in neighbouring ones, and a task writes what its own
    buckets hold: no task gathers a shard, and records aren't moved again.
    """
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What `write_shards` wrote of a table with `schema`; slots tell the order in a shard. No records are no rows."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)
