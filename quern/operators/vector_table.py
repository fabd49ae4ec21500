"""A table of vectors that is refreshed by file: only buckets of files that changed are written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.lineage import written

KEYS = ("file_id", "entry_id", "section_id", "text_hash")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """bucket, file_id, entry_id, section_id, text_hash and vector."""
    return spark.read.parquet(folder)


def build(current: DataFrame, embed: Callable[[DataFrame], DataFrame], folder: str, buckets: int) -> None:
    """Writes the table anew. `embed` adds `vector` to rows of `current`, which has KEYS and what `embed` needs."""
    _write(embed(_bucketed(current, buckets)), folder, "overwrite")


def refresh(current: DataFrame, embed: Callable[[DataFrame], DataFrame], folder: str, buckets: int) -> None:
    """Brings the table to the rows of `current`: the same as `build`, but only touched buckets are written.

    A file has changed where the digest of its keys and text hashes differs from that of the stored rows, which is read without
    vectors; so a refresh that was broken off is mended by the next. A text that the table has under any key keeps its
    vector, and only other texts are embedded, each row once. A null file_id or text_hash is a value like others; equal
    rows are all kept. `buckets` must be that of the build.
    """
    spark = current.sparkSession
    rows, stored = _bucketed(current, buckets), read(spark, folder)
    now, was = _digests(rows), _digests(stored).toDF("_bucket", "_file", "_n", "_digest")
    pairs = now.join(was, now["file_id"].eqNullSafe(was["_file"]), "full_outer")
    changed = pairs.filter(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_digest"))))
    touched = [r[0] for r in changed.select(F.coalesce("bucket", "_bucket")).distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    again = rows.filter(F.col("bucket").isin(touched))
    texts = again.select("text_hash").distinct()
    known = stored.join(texts, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("vector").alias("vector"))
    kept = again.join(known, "text_hash").select("bucket", *KEYS, "vector")
    made = embed(again.join(known.select(F.col("text_hash").alias("_known")), F.col("text_hash") == F.col("_known"), "left_anti"))
    fresh = written(kept.unionByName(made.select("bucket", *KEYS, "vector")))
    _write(fresh, folder, "overwrite", "dynamic")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for b in set(touched) - {r[0] for r in fresh.select("bucket").distinct().collect()}:
        files.delete(path(f"{folder}/bucket={b}"), True)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))


def _digests(rows: DataFrame) -> DataFrame:
    """bucket, file_id, n and digest: the rows of a file in any order, repeated ones included."""
    return rows.groupBy("bucket", "file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*KEYS[1:]).cast("decimal(38,0)")).alias("digest"))


def _write(rows: DataFrame, folder: str, mode: str, overwrite: str = "static") -> None:
    rows.select("bucket", *KEYS, "vector").write.mode(mode).option("partitionOverwriteMode", overwrite).partitionBy("bucket").parquet(folder)
