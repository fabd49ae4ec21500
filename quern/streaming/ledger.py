"""A ledger of events by conversation with cursors without gaps, written by a stream and read after a cursor.

Each micro-batch is a folder named by its number, for events and for heads (the last cursor of each conversation that it
has). A batch takes its first cursors from the heads of earlier batches, and a batch that is run again, after a crash
or a lost driver, writes the same folders anew: what is in the ledger once stays in it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.plans.ordered import running

#: Events of a page, and the most that may be asked for.
PAGE, MOST = 200, 1000


def _append(batch: DataFrame, number: int, folder: str, conversation: str, order: list[str]) -> None:
    spark = batch.sparkSession
    placed = running(batch, [conversation], order, {}, count="_n")
    if number and (heads := _read(spark, f"{folder}/heads")) is not None:
        known = heads.filter(F.col("batch") < number).groupBy(conversation).agg(F.max("head").alias("_head"))
        placed = placed.join(known.withColumnRenamed(conversation, "_c"), placed[conversation].eqNullSafe(F.col("_c")), "left").drop("_c")
    else:
        placed = placed.withColumn("_head", F.lit(None).cast("long"))
    rows = placed.withColumn("cursor", F.coalesce("_head", F.lit(0)) + F.col("_n")).drop("_n", "_head")
    rows.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
    written = spark.read.parquet(f"{folder}/events/batch={number}")
    written.groupBy(conversation).agg(F.max("cursor").alias("head")).write.mode("overwrite").parquet(f"{folder}/heads/batch={number}")


def _read(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*") if there else None


def start(events: DataFrame, folder: str, checkpoint: str, conversation: str, order: list[str], **trigger) -> StreamingQuery:
    """Starts the stream `events` into the ledger; `order` tells events of a batch apart. `trigger` is that of writeStream."""
    sink = events.writeStream.foreachBatch(lambda batch, number: _append(batch, number, folder, conversation, order))
    return sink.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All events of the ledger with batch and cursor."""
    found = _read(spark, f"{folder}/events")
    if found is None:
        raise ValueError(f"no ledger in {folder}")
    return found


def after(ledger: DataFrame, positions: DataFrame, conversation: str, limit: int = PAGE) -> DataFrame:
    """The next events of each conversation in `positions` (conversation, after_cursor): those behind the cursor, at most `limit`.

    Cursors have no gaps, so a page is a range of cursors and needs no ranking.
    """
    most = max(1, min(limit, MOST))
    at = F.greatest(F.lit(0), F.col("after_cursor"))
    asked = positions.select(F.col(conversation).alias("_c"), at.alias("_at"))
    met = ledger.join(asked, ledger[conversation].eqNullSafe(F.col("_c")))
    return met.filter((F.col("cursor") > F.col("_at")) & (F.col("cursor") <= F.col("_at") + most)).select(*ledger.columns)
