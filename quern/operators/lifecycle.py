"""Maintenance: lifecycle changes, merges of tags, retention, task queues, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _before(now: str, **ago: int) -> Column:
    (unit, n), = ago.items()
    return F.timestamp_add(unit.upper().removesuffix("S"), F.lit(-n), F.lit(now).cast("timestamp_ntz"))


def demotable(entries: DataFrame, mentions: DataFrame, now: str, quiet_days: int = 30, age_days: int = 14) -> DataFrame:
    """Live active entries old enough that no note since mentions. `mentions` has entry_id and at."""
    recent = mentions.filter(F.col("at") >= _before(now, days=quiet_days))
    old = entries.filter((F.col("lifecycle") == "active") & F.col("deleted_at").isNull() & (F.col("created_at") <= _before(now, days=age_days)))
    return old.join(recent, "entry_id", "left_anti")


def archivable(entries: DataFrame, mentions: DataFrame, now: str, quiet_days: int = 90, demoted_days: int = 30) -> DataFrame:
    """Live demoted entries that have been so for long and that no note since mentions."""
    recent = mentions.filter(F.col("at") >= _before(now, days=quiet_days))
    old = entries.filter((F.col("lifecycle") == "demoted") & F.col("deleted_at").isNull() & (F.col("updated_at") <= _before(now, days=demoted_days)))
    return old.join(recent, "entry_id", "left_anti")


def transition(entries: DataFrame, ids: DataFrame, source: str, target: str) -> DataFrame:
    """Entries with the lifecycle of those in `ids` changed, where it still is `source`."""
    marked = entries.join(ids.select("entry_id", F.lit(True).alias("_m")).distinct(), "entry_id", "left")
    return marked.withColumn("lifecycle", F.when(F.col("_m") & (F.col("lifecycle") == source), target).otherwise(F.col("lifecycle"))).drop("_m")


def merge_tags(entry_tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Bridge rows with each tag replaced by what it is an alias of (one hop); rows that become equal are one."""
    mapped = entry_tags.join(aliases.select(F.col("tag").alias("_t"), "canonical"), F.col("name") == F.col("_t"), "left")
    return mapped.select("entry_id", F.coalesce("canonical", "name").alias("name")).distinct()


def usage_counts(tags: DataFrame, entry_tags: DataFrame) -> DataFrame:
    """Entries of every tag, zero included."""
    counted = entry_tags.groupBy("name").agg(F.countDistinct("entry_id").alias("_n"))
    return tags.join(counted, "name", "left").select(*tags.columns, F.coalesce("_n", F.lit(0)).alias("doc_count"))


def prune(rows: DataFrame, time: str, cutoff: str, key: str, batch: int | None = None) -> DataFrame:
    """Rows left after the oldest ones before the cutoff go, at most `batch` of them."""
    due = rows.filter(F.col(time) < F.lit(cutoff).cast("timestamp_ntz")).orderBy(time, key)
    return rows.join((due if batch is None else due.limit(batch)).select(key), key, "left_anti")


def orphans(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that no entry refers to, deleted or not."""
    return files.join(entries.select("file_id"), "file_id", "left_anti")


def dedupe_content(files: DataFrame) -> DataFrame:
    """file_id, seed and copies: each file with the oldest live one of the same bytes, which is found in one pass."""
    live = files.filter("deleted_at IS NULL").select("file_id", "sha256", "ingested_at")
    seeds = live.groupBy(F.col("sha256").alias("_s")).agg(F.min_by("file_id", F.struct("ingested_at", "file_id")).alias("seed"), F.count(F.lit(1)).alias("copies"))
    return live.join(seeds, F.col("sha256").eqNullSafe(F.col("_s"))).select("file_id", "seed", "copies")


def recover(tasks: DataFrame, now: str, grace_seconds: int = 10, max_attempts: int = 3) -> DataFrame:
    """Running tasks whose lease is over go back to pending, or are dead where attempts are used up."""
    over = (F.col("status") == "running") & (F.col("lease_until") < _before(now, seconds=grace_seconds))
    return tasks.withColumn("status", F.when(over & (F.col("attempts") >= max_attempts), "dead").when(over, "pending").otherwise(F.col("status")))


def active_keys(tasks: DataFrame, now: str) -> DataFrame:
    """Tasks with the best active one of each key kept: running with a lease, pending, expired, the rest; others die."""
    active = F.col("status").isin("pending", "running")
    live = (F.col("status") == "running") & (F.col("lease_until") >= F.lit(now).cast("timestamp_ntz"))
    grade = F.when(live, 0).when(F.col("status") == "pending", 1).when(F.col("attempts") < 3, 2).otherwise(3)
    place = F.row_number().over(W.partitionBy("dedup_key", active).orderBy(grade, "scheduled_at", "id"))
    return tasks.withColumn("status", F.when(active & (place > 1), "dead").otherwise(F.col("status")))


def enqueue(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """`tasks` and those of `new` whose key isn't active, one a key."""
    active = tasks.filter(F.col("status").isin("pending", "running")).select("dedup_key")
    fresh = new.join(active, "dedup_key", "left_anti").withColumn("_n", F.row_number().over(W.partitionBy("dedup_key").orderBy("id"))).filter("_n = 1").drop("_n")
    return tasks.unionByName(fresh)


#: The kinds of tasks that throughput tells of, and the longest window in minutes.
THROUGHPUT_KINDS = ("ingest_file", "reprocess_file")
LONGEST_WINDOW = 24 * 60


def throughput(tasks: DataFrame, now: str, window_minutes: int = 60) -> DataFrame:
    """A row for each kind: what waits and runs now, what ended in the window, and how well and how fast.

    `tasks` has kind, scheduled_by, status, scheduled_at, started_at and finished_at. A task of ingestion that something else
    scheduled counts as reprocessing; other kinds don't count. done and failed (dead) are those that finished in the last
    `window_minutes` (1 to a day); the success rate is done / (done + failed), the mean duration is from start to end of
    both, a negative one being 0, and both are null where nothing ended. Kinds without tasks have zeros.
    """
    minutes = min(max(window_minutes, 1), LONGEST_WINDOW)
    moment = F.lit(now).cast("timestamp_ntz")
    seconds = lambda first, last: F.unix_seconds(last.cast("timestamp")) - F.unix_seconds(first.cast("timestamp"))
    by = F.when(F.coalesce("scheduled_by", F.lit("")) != "", "reprocess_file").otherwise(F.col("kind"))
    ended = F.col("status").isin("done", "dead") & (F.col("finished_at") >= moment - F.expr(f"INTERVAL {minutes} MINUTE"))
    took = F.greatest(F.lit(0.0), (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6)
    waits = F.col("status") == "pending"
    done, failed = F.count_if(ended & (F.col("status") == "done")), F.count_if(ended & (F.col("status") == "dead"))
    counted = tasks.filter(F.col("kind").isin(*THROUGHPUT_KINDS)).groupBy(by.alias("kind")).agg(
        F.count_if(waits).alias("pending"), F.count_if(F.col("status") == "running").alias("running"), done.alias("done"), failed.alias("failed"),
        F.greatest(F.lit(0), F.max(F.when(waits, seconds(F.col("scheduled_at"), moment)))).alias("oldest_pending_age_seconds"),
        F.avg(F.when(ended & F.col("started_at").isNotNull(), took)).alias("average_duration_seconds"),
    )
    kinds = tasks.sparkSession.createDataFrame([(k,) for k in THROUGHPUT_KINDS], "kind string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = kinds.join(counted, "kind", "left").select("kind", *[zero(c) for c in ("pending", "running", "done", "failed", "oldest_pending_age_seconds")], "average_duration_seconds")
    return rows.withColumn("success_rate", F.try_divide("done", F.col("done") + F.col("failed"))).withColumn("completed_per_minute", F.col("done") / minutes)


def backoff(attempts: Column, base: float = 2.0, most: float = 300.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempts - 1), F.lit(most))


def slot(ts: Column, minutes: int = 10) -> Column:
    """Number of the time slot since 1970, UTC."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / (60 * minutes)).cast("long")


def capped_new(pairs: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """Mined pairs in order of strength until `cap` new ones are among them; known ones before that pass freely.

    The cap is a setting of the miner, counted over a total order.
    """
    marked = pairs.join(known.select("a", "b", F.lit(1).alias("_k")), ["a", "b"], "left")
    new = marked.filter("_k IS NULL").orderBy(F.col("observation_count").desc(), "a", "b").limit(cap)
    last = new.orderBy(F.col("observation_count").asc(), F.col("a").desc(), F.col("b").desc()).limit(1).select(F.col("observation_count").alias("_c"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    total = new.agg(F.count(F.lit(1)).alias("_n"))
    bound = marked.crossJoin(F.broadcast(total)).join(F.broadcast(last), how="left")  # one row each
    before = (F.col("observation_count") > F.col("_c")) | ((F.col("observation_count") == F.col("_c")) & (F.struct("a", "b") <= F.struct("_a", "_b")))
    return bound.filter((F.col("_n") < cap) | before).select("a", "b", "observation_count", F.col("_k").isNull().alias("is_new"))


def due(kinds: DataFrame, done: DataFrame, now: str) -> DataFrame:
    """Task kinds (kind, every_seconds) whose last run (kind, at) is an interval ago or never was."""
    last = done.groupBy("kind").agg(F.max("at").alias("last_at"))
    passed = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last_at").cast("timestamp"))
    return kinds.join(last, "kind", "left").filter(F.col("last_at").isNull() | (passed >= F.col("every_seconds"))).select("kind", "last_at")
