"""Leases of tasks that run out in event time: state by buckets of tasks, a timer at the earliest lease's end and grace."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: seconds that a lease may be over.
GRACE_SECONDS = 10
_OUT = "task_id long, status string, at timestamp"
#: Tasks are held by buckets: one call a bucket and batch of the stream, whatever the number of its tasks.
BUCKETS, _STATE = 1024, "held binary"
_HELD = ["_none", "task_id", "_ts", "status", "attempts", "_lease"]


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows[_HELD], preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _expiry(max_attempts: int, grace: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        parts = [pa.ipc.open_stream(state.get[0]).read_all().to_pandas().assign(_new=False)] if state.exists else []
        if not state.hasTimedOut:
            parts += [batch[_HELD].assign(_new=True) for batch in batches]
        rows = pd.concat(parts, ignore_index=True)
        # the last event by its own time decides, in whatever order events come; a task that has one now is told by a later batch
        new = rows.groupby(["_none", "task_id"])["_new"].transform("any")
        rows = rows.assign(_new=new).sort_values(["_none", "task_id", "_ts", "status"], kind="stable").drop_duplicates(["_none", "task_id"], keep="last")
        due = rows["_lease"] // 1000 + grace * 1000 + 1
        running = rows["status"] == "running"
        over = running & ~rows["_new"] & (due < now)
        if over.any():
            told = rows[over]
            yield pd.DataFrame({
                "task_id": told["task_id"].astype("Int64").mask(told["_none"]), "status": np.where(told["attempts"] >= max_attempts, "dead", "pending"),
                "at": pd.to_datetime(told["_lease"] + grace * 1_000_000, unit="us"),
            })
        # what is over before the watermark needs no memory: earlier events don't come any more
        kept = ~over & (running | (rows["_ts"] // 1000 >= now))
        if not kept.any():
            state.remove()
            return
        state.update((_packed(rows[kept]),))
        if (kept & running).any():
            state.setTimeoutTimestamp(int(max(due[kept & running].min(), now + 1)))

    return step


def expired(events: DataFrame, max_attempts: int = 3, grace_seconds: int = GRACE_SECONDS, late: str = "1 hour") -> DataFrame:
    """task_id, status (pending again, or dead where attempts are used up) and at: tasks whose lease ran out while they ran.

    `events` is a stream of task_id, ts, status, attempts and lease_until: claims, renewals and ends. A task's last event by
    event time counts; its lease is over once the watermark, `late` behind the latest event, has passed its end and the
    grace. Events later than the watermark are dropped, as their task may have been told already.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = rows.select(F.col("task_id").cast("long").alias("task_id"), "ts", "status", F.col("attempts").cast("int").alias("attempts"), micros("ts").alias("_ts"), F.coalesce(micros("lease_until"), F.lit(0)).alias("_lease"))
    # columns without nulls keep their type in pandas
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(BUCKETS)).cast("int").alias("_bucket")
    rows = rows.select(bucket, "ts", F.col("task_id").isNull().alias("_none"), F.coalesce("task_id", F.lit(0)).alias("task_id"), "_ts", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "_lease").filter("_ts IS NOT NULL")
    step = _expiry(max_attempts, grace_seconds)
    return rows.groupBy("_bucket").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def expired_at(events: DataFrame, now: str, max_attempts: int = 3, grace_seconds: int = GRACE_SECONDS) -> DataFrame:
    """The same of a table of events, at a moment: the batch form."""
    last = F.max_by(F.struct("status", "attempts", "lease_until"), F.struct("ts", "status"))
    rows = events.groupBy("task_id").agg(last.alias("l")).select("task_id", "l.*")
    end = F.col("lease_until").cast("timestamp") + F.expr(f"INTERVAL {grace_seconds} SECOND")
    over = rows.filter((F.col("status") == "running") & (end < F.lit(now).cast("timestamp")))
    return over.select(F.col("task_id").cast("long").alias("task_id"), F.when(F.col("attempts") >= max_attempts, "dead").otherwise("pending").alias("status"), end.alias("at"))
