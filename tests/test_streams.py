"""Streams that stop, start again and run a batch twice, against the batch forms."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.streaming import leases, ledger
from tests.oracle import SF


def in_turn(frame, folder, parts, order):
    """Files one after another in time, so that a stream reads them in order."""
    for n, part in enumerate(parts):
        frame.join(part, "event_id", "left_semi").orderBy(*order).coalesce(1).write.mode("append").parquet(str(folder))


def test_ledger_resumes_and_replays(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    ranked = events.withColumn("_p", F.ntile(5).over(W.orderBy("ts", "event_id")))
    in_turn(events, tmp_path / "in", [ranked.filter(F.col("_p") == p).select("event_id") for p in range(1, 6)], ["ts"])
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    run = lambda frame: ledger.start(frame, out, marks, "user_id", ["ts", "event_id"])

    seen = []

    def broken(batch, number):
        ledger._append(batch, number, out, "user_id", ["ts", "event_id"])
        seen.append(number)
        if number == 2:
            raise RuntimeError("stopped after the write, before the batch is committed")

    first = stream().writeStream.foreachBatch(broken).option("checkpointLocation", marks).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="stopped after"):
        first.awaitTermination()
    assert seen == [0, 1, 2]
    run(stream()).awaitTermination()
    want = {(r.event_id, r.cursor) for r in events.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("cursor")).collect()}
    rows = ledger.read(spark, out)
    assert sorted((r.event_id, r.cursor) for r in rows.collect()) == sorted(want)
    # a batch that a lost driver didn't commit is run again
    shutil.rmtree(tmp_path / "out" / "heads" / "batch=4")
    (tmp_path / "marks" / "commits" / "4").unlink()
    for crc in (tmp_path / "marks" / "commits").glob(".4.crc"):
        crc.unlink()
    run(stream()).awaitTermination()
    rows = ledger.read(spark, out)
    assert sorted((r.event_id, r.cursor) for r in rows.collect()) == sorted(want)
    user = rows.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()
    asked = spark.createDataFrame([(user.user_id, 2), (10**9, 0)], "user_id long, after_cursor long")
    assert sorted(r.cursor for r in ledger.after(rows, asked, "user_id", 3).collect()) == list(range(3, min(5, user["count"]) + 1))


def test_leases_run_out_in_event_time(spark, tmp_path):
    rng = random.Random(4)
    at = lambda minute, second=0: f"2024-01-01 {10 + minute // 60:02d}:{minute % 60:02d}:{second:02d}"
    rows = []
    for task in range(40):
        start = rng.randrange(0, 100)
        rows.append((task, at(start), "running", rng.randrange(1, 5), at(start + 5)))
        if task % 3 == 0:  # renewed
            rows.append((task, at(start + 4), "running", rng.randrange(1, 5), at(start + 30)))
        if task % 4 == 0:
            rows.append((task, at(start + 8), "done", 1, None))
    rows.append((99, at(300), "other", 0, None))  # moves the watermark past all leases
    schema = "task_id long, ts string, status string, attempts int, lease_until string"
    cast = lambda df: df.select("task_id", F.col("ts").cast("timestamp").alias("ts"), "status", "attempts", F.col("lease_until").cast("timestamp").alias("lease_until"))
    ordered = sorted(rows, key=lambda r: r[1])
    # neighbours change places: events come late, inside the watermark
    for i in range(0, len(ordered) - 3, 3):
        ordered[i], ordered[i + 1] = ordered[i + 1], ordered[i]
    for n in range(0, len(ordered), 12):
        cast(spark.createDataFrame(ordered[n : n + 12], schema)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):  # stopped and started again
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        told = leases.expired(stream, late="40 minutes")
        told.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    want = leases.expired_at(source, at(299))
    rows_of = lambda df: sorted((r.task_id, r.status, str(r["at"])) for r in df.collect())
    assert rows_of(spark.read.parquet(out)) == rows_of(want) and want.count() > 10


def test_leases_are_held_by_buckets(spark, tmp_path, monkeypatch):
    """Thousands of tasks in four buckets: a call of Python holds many, and a batch with other tasks of a bucket tells those that are over."""
    monkeypatch.setattr(leases, "BUCKETS", 4)
    claims = spark.range(6000).select(
        F.when(F.col("id") > 0, F.col("id") + (1 << 60)).alias("task_id"), F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("ts"),
        F.when(F.col("id") % 7 == 0, "done").otherwise("running").alias("status"), (F.col("id") % 5).cast("int").alias("attempts"),
    ).withColumn("lease_until", F.timestamp_add("SECOND", F.lit(60), "ts"))
    for n in range(5):  # in the order of time
        claims.filter((F.unix_timestamp("ts") - F.lit(1704067200)).between(n * 1200, n * 1200 + 1199)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = leases.expired(stream, late="10 minutes")
    told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    want = leases.expired_at(spark.read.parquet(str(tmp_path / "in")), "2024-01-01 01:29:59")
    rows_of = lambda df: sorted((r.task_id or 0, r.status, str(r["at"])) for r in df.collect())
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(want) and want.count() > 4000
