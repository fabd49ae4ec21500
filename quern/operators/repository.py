"""Plain lookups and state changes over the store's tables, named for what they return.

Tables have the columns of `quern.schemas`. An id set is a DataFrame with a column `id`; conditional changes return the
whole table with the rows changed, since plain tables have no update in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACTIVE = ("active", "manual_active")


def live(rows: DataFrame) -> DataFrame:
    return rows.filter("deleted_at IS NULL")


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in the id set."""
    return rows.join(ids.select(F.col("id").alias("_id")).distinct(), F.col(key) == F.col("_id"), "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows left after those of the id set are deleted; rows with a null key stay."""
    return rows.join(ids.select(F.col("id").alias("_id")).distinct(), F.col(key) == F.col("_id"), "left_anti")


def names(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """id and name, deleted or not."""
    return by_ids(rows, ids).select("id", "name")


def change(rows: DataFrame, where: Column, **values: Column | str | None) -> DataFrame:
    """The table with columns set where the condition holds; a condition that is null holds nowhere."""
    hit = F.coalesce(where, F.lit(False))
    return rows.select(*[F.when(hit, _lit(values[c], rows, c)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def _lit(value, rows: DataFrame, column: str) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast(dict(rows.dtypes)[column])


# trees: folders and catalogs


def children(nodes: DataFrame, parent: str | None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Live children by name; the parent None is the root."""
    rows = live(nodes).filter(F.col("parent_id").eqNullSafe(F.lit(parent))).orderBy("name", "id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def count_children(nodes: DataFrame, parent: str | None) -> DataFrame:
    return live(nodes).filter(F.col("parent_id").eqNullSafe(F.lit(parent))).agg(F.count(F.lit(1)).alias("n"))


def child_named(nodes: DataFrame, parent: str | None, name: str, other_than: str | None = None) -> DataFrame:
    rows = live(nodes).filter(F.col("parent_id").eqNullSafe(F.lit(parent)) & (F.col("name") == name))
    return rows if other_than is None else rows.filter(F.col("id") != other_than)


def entries_in(entries: DataFrame, files: DataFrame, column: str, value: str | None) -> DataFrame:
    """Live entries in one folder or catalog with the ingest status of their live file, by display name."""
    f = live(files).select(F.col("id").alias("_f"), "ingest_status")
    rows = live(entries).filter(F.col(column).eqNullSafe(F.lit(value))).join(f, F.col("file_id") == F.col("_f")).drop("_f")
    return rows.orderBy("display_name", "id")


def newest_in_catalog(entries: DataFrame, catalog: str, limit: int, offset: int = 0) -> DataFrame:
    return live(entries).filter(F.col("catalog_id") == catalog).orderBy(F.col("updated_at").desc(), "id").offset(offset).limit(limit)


def reassign(entries: DataFrame, source: str, target: str | None, now: str) -> DataFrame:
    """Entries of one catalog moved to another."""
    return change(entries, F.col("catalog_id") == source, catalog_id=target, updated_at=now)


# entries and files


def with_file(entries: DataFrame, files: DataFrame, any_state: bool = False) -> DataFrame:
    """Entries and their files; both live unless `any_state`. File columns get the prefix file_."""
    e, f = (entries, files) if any_state else (live(entries), live(files))
    f = f.select(*[F.col(c).alias("_f" if c == "id" else f"file_{c}") for c in f.columns])
    return e.join(f, F.col("file_id") == F.col("_f")).drop("_f")


def active_with_file(entries: DataFrame, files: DataFrame) -> DataFrame:
    return with_file(entries.filter(F.col("lifecycle").isin(*ACTIVE)), files)


def recently_updated(entries: DataFrame, limit: int) -> DataFrame:
    return live(entries).filter(F.col("lifecycle").isin(*ACTIVE)).orderBy(F.col("updated_at").desc(), "id").limit(limit)


def file_in_use(files: DataFrame, entries: DataFrame, deleted_too: bool = False) -> DataFrame:
    """id and whether any entry (live, or any at all) refers to the file."""
    used = (entries if deleted_too else live(entries)).select(F.col("file_id").alias("_f"), F.lit(True).alias("_u")).distinct()
    return files.join(used, F.col("id") == F.col("_f"), "left").select("id", F.coalesce("_u", F.lit(False)).alias("in_use"))


def oldest_by_content(files: DataFrame, sha256: str) -> DataFrame:
    return live(files).filter(F.col("sha256") == sha256).orderBy("created_at", "id").limit(1)


def file_ids(files: DataFrame, status: str | None = None) -> DataFrame:
    """Ids of live files, oldest first."""
    rows = live(files) if status is None else live(files).filter(F.col("ingest_status") == status)
    return rows.orderBy("created_at", "id").select("id")


def file_ids_of(files: DataFrame, entries: DataFrame, column: str, values: DataFrame, status: str | None = None) -> DataFrame:
    """Distinct live files whose live entries lie in any of the folders or catalogs (an id set)."""
    placed = by_ids(live(entries), values, column).select(F.col("file_id").alias("id"))
    return by_ids(live(files) if status is None else live(files).filter(F.col("ingest_status") == status), placed).select("id")


def fail_ingest(files: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Live files of the id set whose ingest isn't done are marked as failed."""
    marked = files.join(ids.select(F.col("id").alias("_id"), F.lit(True).alias("_m")).distinct(), F.col("id") == F.col("_id"), "left")
    return change(marked, F.col("_m") & F.col("deleted_at").isNull() & (F.col("ingest_status") != "done"), ingest_status="failed", updated_at=now).drop("_id", "_m")


# tags and relations


def tags_of(entry_tags: DataFrame, tags: DataFrame, ids: DataFrame) -> DataFrame:
    """entry_id, tag_id, name, facet and source of every tag on the entries; aliases aren't told, where the table has any."""
    tags = tags.filter("alias_of IS NULL") if "alias_of" in tags.columns else tags
    return by_ids(entry_tags, ids, "entry_id").join(tags.select(F.col("id").alias("tag_id"), "name", "facet"), "tag_id").select("entry_id", "tag_id", "name", "facet", "source")


def live_pairs(entry_tags: DataFrame, entries: DataFrame, active_only: bool = False) -> DataFrame:
    """entry_id, tag_id where the entry is live (and active)."""
    e = live(entries)
    return by_ids(entry_tags, e.filter(F.col("lifecycle").isin(*ACTIVE)) if active_only else e, "entry_id").select("entry_id", "tag_id")


def canonical(tags: DataFrame, facet: str | None = None, limit: int | None = None) -> DataFrame:
    """Tags that are no aliases, most used first."""
    rows = tags.filter("alias_of IS NULL")
    rows = (rows if facet is None else rows.filter(F.col("facet") == facet)).orderBy(F.col("doc_count").desc(), "name", "id").select("id", "name", "facet", "doc_count")
    return rows if limit is None else rows.limit(limit)


def relations_touching(relations: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Relations with either end in the id set, or with `keep` False those with none."""
    marked = relations.join(ids.select(F.col("id").alias("_a")).distinct(), F.col("entry_a_id") == F.col("_a"), "left").join(ids.select(F.col("id").alias("_b")).distinct(), F.col("entry_b_id") == F.col("_b"), "left")
    hit = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    return marked.filter(hit if keep else ~hit).drop("_a", "_b")


def vetted_pairs(relations: DataFrame) -> DataFrame:
    return relations.filter("vetted IS TRUE").select("entry_a_id", "entry_b_id")


def vet_candidates(relations: DataFrame, entries: DataFrame, least: int, limit: int) -> DataFrame:
    """Unjudged relations seen often enough, both ends live, strongest first."""
    ids = live(entries).select("id")
    rows = by_ids(by_ids(relations.filter(F.col("vetted").isNull() & (F.col("observation_count") >= least)), ids, "entry_a_id"), ids, "entry_b_id")
    return rows.orderBy(F.col("observation_count").desc(), "id").limit(limit)


def record_verdicts(relations: DataFrame, verdicts: DataFrame, now: str) -> DataFrame:
    """Relations with the verdicts (id, vetted) of a decision table and the count they were judged at."""
    v = verdicts.select(F.col("id").alias("_id"), F.col("vetted").alias("_v"))
    marked = relations.join(v, F.col("id") == F.col("_id"), "left")
    return change(marked, F.col("_id").isNotNull(), vetted=F.col("_v"), vetted_at=F.lit(now).cast(dict(relations.dtypes)["vetted_at"]), vetted_observation_count=F.col("observation_count")).drop("_id", "_v")


# journal, sessions, outcomes


def active_notes(journal: DataFrame, kind: str | None = None) -> DataFrame:
    """Notes neither superseded nor invalidated, newest first."""
    rows = journal.filter("superseded_by_id IS NULL AND invalidated_at IS NULL")
    return (rows if kind is None else rows.filter(F.col("source_kind") == kind)).orderBy(F.col("created_at").desc(), "id")


def notes_about(journal: DataFrame, ids: list[str], before: str, limit: int) -> DataFrame:
    """Newest active notes before a time that mention any of the entries."""
    rows = active_notes(journal).filter(F.arrays_overlap("entry_ids", F.array(*[F.lit(i) for i in ids])) & (F.col("created_at") < F.lit(before).cast("timestamp")))
    return rows.orderBy(F.col("created_at").desc(), "id").limit(limit)


def supersede(journal: DataFrame, old: str, new: str) -> DataFrame:
    return change(journal, (F.col("id") == old) & F.col("superseded_by_id").isNull(), superseded_by_id=new)


def invalidate(journal: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    marked = journal.join(ids.select(F.col("id").alias("_id"), F.lit(True).alias("_m")).distinct(), F.col("id") == F.col("_id"), "left")
    return change(marked, F.col("_m") & F.col("invalidated_at").isNull(), invalidated_at=now).drop("_id", "_m")


def last_turns(conversations: DataFrame, unfinished: bool = False) -> DataFrame:
    """The conversation with the highest turn of each session (of those not finished)."""
    rows = conversations.filter("ended_at IS NULL") if unfinished else conversations
    place = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("turn_index").desc(), "id"))
    return rows.withColumn("_p", place).filter("_p = 1").drop("_p")


def session_modes(conversations: DataFrame) -> DataFrame:
    """session_id and the mode of its latest model call that has one."""
    modes = F.transform(F.filter("llm_calls", lambda c: c["mode"].isNotNull()), lambda c: c["mode"])
    rows = conversations.select("session_id", "turn_index", F.get(modes, F.size(modes) - 1).alias("mode"))
    return rows.filter("mode IS NOT NULL").groupBy("session_id").agg(F.max_by("mode", "turn_index").alias("mode"))


def rolled_up(sessions: DataFrame, conversations: DataFrame) -> DataFrame:
    """Sessions with turns and token totals counted from their conversations."""
    tokens = [_total(n) for n in ("input_tokens", "output_tokens")]
    sums = conversations.groupBy(F.col("session_id").alias("_s")).agg(F.count(F.lit(1)).cast("int").alias("_t"), F.sum(tokens[0]).alias("_i"), F.sum(tokens[1]).alias("_o"))
    rows = sessions.join(sums, F.col("id") == F.col("_s"), "left")
    rows = rows.withColumn("turn_count", F.coalesce("_t", F.lit(0))).withColumn("total_input_tokens", F.coalesce("_i", F.lit(0))).withColumn("total_output_tokens", F.coalesce("_o", F.lit(0)))
    return rows.drop("_s", "_t", "_i", "_o")


def _total(field: str) -> Column:
    return F.coalesce(F.aggregate("llm_calls", F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c[field], F.lit(0))), F.lit(0))


def outcomes_since(outcomes: DataFrame, task: str, kind: str, since: str | None = None) -> DataFrame:
    """Distinct objects that a task has worked on (since a time)."""
    rows = outcomes.filter((F.col("task_kind") == task) & (F.col("object_kind") == kind))
    return (rows if since is None else rows.filter(F.col("completed_at") >= F.lit(since).cast("timestamp"))).select("object_id").distinct()


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """The last outcome of each task and object."""
    place = F.row_number().over(W.partitionBy("task_kind", "object_kind", "object_id").orderBy(F.col("completed_at").desc(), "outcome"))
    return outcomes.withColumn("_p", place).filter("_p = 1").drop("_p")


def latest_failures(audit: DataFrame, ids: DataFrame) -> DataFrame:
    """file_id and the latest reason of a failed ingest in the audit log."""
    rows = audit.filter("kind = 'ingest_status'").select(F.get_json_object("payload", "$.file_id").alias("file_id"), F.get_json_object("payload", "$.status").alias("s"), F.get_json_object("payload", "$.reason").alias("reason"), "occurred_at")
    return by_ids(rows.filter("s = 'failed'"), ids, "file_id").groupBy("file_id").agg(F.max_by("reason", "occurred_at").alias("reason"))


def oldest(rows: DataFrame, time: str) -> DataFrame:
    return rows.agg(F.min(time).alias("oldest"))
