"""Metadata search over live entries: filters, joins, pages, prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import contains_any, facet_weight, hits, query_terms, rank_terms, search_terms, search_weight

ACTIVE = ("active", "manual_active")
#: Weights of fields in metadata ranking.
FIELD_WEIGHTS = {"display_name": 22.0, "summary": 14.0, "file_extra": 10.0, "extra": 10.0, "description": 6.0, "original_ext": 1.0}


def live(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries with their file, both not deleted."""
    f = files.filter("deleted_at IS NULL").drop("deleted_at")
    return entries.filter("deleted_at IS NULL").drop("deleted_at").join(f, "file_id")


def with_all_tags(entries: DataFrame, entry_tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Entries that have every tag: one count over the tags' rows, however many tags there are."""
    wanted = list(dict.fromkeys(names))
    found = entry_tags.filter(F.col("name").isin(wanted)).groupBy("entry_id").agg(F.countDistinct("name").alias("_n")).filter(F.col("_n") == len(wanted))
    return entries.join(found, "entry_id", "left_semi")


def with_any_tag(entries: DataFrame, entry_tags: DataFrame, names: Sequence[str]) -> DataFrame:
    return entries.join(entry_tags.filter(F.col("name").isin(list(names))), "entry_id", "left_semi")


def without_tags(entries: DataFrame, entry_tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Entries with none of the tags; a null id in the tags removes nothing."""
    return entries.join(entry_tags.filter(F.col("name").isin(list(names))), "entry_id", "left_anti")


def filter_entries(
    rows: DataFrame,
    entry_tags: DataFrame,
    text: Sequence[str] | None = None,
    lifecycle: Sequence[str] | None = None,
    kind: str | None = None,
    catalogs: Sequence[str] | None = None,
    folders: Sequence[str] | None = None,
    tags_all: Sequence[str] = (),
    tags_any: Sequence[str] = (),
    tags_none: Sequence[str] = (),
    ids: Sequence[int] | None = None,
) -> DataFrame:
    """The conjunction of all given conditions; a list that is given but empty matches nothing."""
    for column, values in (("lifecycle", lifecycle), ("catalog_id", catalogs), ("folder_id", folders), ("entry_id", ids)):
        if values is not None:
            rows = rows.filter(F.col(column).isin(list(values)) if len(values) else F.lit(False))
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if text:
        rows = rows.filter(contains_any([F.col("display_name"), F.col("summary"), F.col("folder_id"), F.col("catalog_id")], list(text)))
    if tags_all:
        rows = with_all_tags(rows, entry_tags, tags_all)
    if tags_any:
        rows = with_any_tag(rows, entry_tags, tags_any)
    if tags_none:
        rows = without_tags(rows, entry_tags, tags_none)
    return rows


def rank_score(terms: Sequence[str], fields: dict[str, float]) -> Column:
    """Sum over terms of term weight x (field weight x at most three hits), plus 5 x the share of terms found."""
    total, covered = F.lit(0.0), F.lit(0.0)
    for t in terms:
        found = F.lit(0.0)
        for column, weight in fields.items():
            found = found + F.lit(weight) * F.least(hits(F.col(column), t), F.lit(3))
        total = total + found * F.lit(search_weight(t))
        covered = covered + F.when(found > 0, 1.0).otherwise(0.0)
    return total + 5.0 * covered / len(terms) if terms else total


def tag_bonus(entry_tags: DataFrame, terms: Sequence[str], requested: Sequence[str] = ()) -> DataFrame:
    """entry_id and bonus: facet weight + 4 for each requested tag, facet weight x term weight for each term in a name."""
    w = facet_weight(F.col("facet"))
    bonus = F.when(F.col("name").isin(list(requested)), w + 4.0).otherwise(F.lit(0.0))
    for t in terms:
        bonus = bonus + F.when(hits(F.col("name"), t) > 0, w * search_weight(t)).otherwise(0.0)
    return entry_tags.select("entry_id", bonus.alias("_b")).filter("_b > 0").groupBy("entry_id").agg(F.sum("_b").alias("bonus"))


def search_metadata(rows: DataFrame, query: str, entry_tags: DataFrame, fields: dict[str, float] | None = None, requested: Sequence[str] = (), limit: int = 20, offset: int = 0) -> DataFrame:
    """Live rows that hold a term of the query in any field, best first; ties by newest, then id."""
    fields = FIELD_WEIGHTS if fields is None else fields
    found = rows.filter(contains_any([F.col(c) for c in fields], search_terms(query)))
    terms = rank_terms(query_terms(query))
    found = found.join(tag_bonus(entry_tags, terms, requested), "entry_id", "left")
    found = found.withColumn("score", F.round(rank_score(terms, fields) + F.coalesce("bonus", F.lit(0.0)), 6))
    return found.orderBy(F.col("score").desc(), F.col("updated_at").desc(), "entry_id").offset(offset).limit(limit)


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with `total`, `has_more` and `next_offset` on each row."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    end = F.lit(offset) + F.least(F.lit(limit), F.greatest(F.col("total") - offset, F.lit(0)))
    return part.crossJoin(F.broadcast(total)).withColumn("has_more", end < F.col("total")).withColumn("next_offset", F.when(end < F.col("total"), end))  # one row


def after(rows: DataFrame, time: str, key: str, cursor: tuple, limit: int) -> DataFrame:
    """The page of newest rows behind a cursor (time, key), without counting from the start."""
    t, k = F.lit(cursor[0]).cast("timestamp_ntz"), F.lit(cursor[1])
    return rows.filter((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k))).orderBy(F.col(time).desc(), F.col(key).desc()).limit(limit)


def resolve_prefix(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For each prefix (8 characters or more): how many ids start with it, and the id where it is the only one.

    Ids and prefixes meet on their first 8 characters, so no pair is tried that can't match.
    """
    head = F.substring("id", 1, 8)
    p = prefixes.filter(F.length("prefix") >= 8).select("prefix", F.substring("prefix", 1, 8).alias("_h"))
    met = p.join(ids.select(F.col("id"), head.alias("_h")), "_h", "left").filter(F.col("id").isNull() | F.startswith("id", "prefix"))
    found = met.groupBy("prefix").agg(F.count("id").alias("matches"), F.min("id").alias("_first"))
    return found.select("prefix", "matches", F.when(F.col("matches") == 1, F.col("_first")).alias("id"))


def top_per(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank; Spark cuts each task's groups before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], merged: dict[str, Column]) -> DataFrame:
    """Full merge by key; `merged` says each other column from `o.` and `n.`."""
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), on, "full_outer")
    key = [F.when(F.col("o._o"), F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys]
    return both.select(*key, *[c.alias(name) for name, c in merged.items()])


def reconcile_paths(tracked: DataFrame, found: DataFrame) -> DataFrame:
    """path, sha and status of a directory against the store: in_sync, modified, moved, missing, new.

    Equal paths first; what is left is matched by content, the first missing path with the first new one.
    """
    both = tracked.alias("t").join(found.alias("f"), F.col("t.path") == F.col("f.path"), "full_outer")
    both = both.select(F.col("t.path").alias("old"), F.col("f.path").alias("new"), F.col("t.sha").alias("old_sha"), F.col("f.sha").alias("new_sha"))
    same = both.filter("old IS NOT NULL AND new IS NOT NULL").select("old", "new", F.when(F.col("old_sha") == F.col("new_sha"), "in_sync").otherwise("modified").alias("status"))
    gone = both.filter("new IS NULL").select("old", F.col("old_sha").alias("sha"), F.row_number().over(W.partitionBy("old_sha").orderBy("old")).alias("n"))
    come = both.filter("old IS NULL").select("new", F.col("new_sha").alias("sha"), F.row_number().over(W.partitionBy("new_sha").orderBy("new")).alias("n"))
    moved = gone.join(come, ["sha", "n"], "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").otherwise("moved")
    return same.unionByName(moved.select("old", "new", status.alias("status")))


def resolve_tags(wanted: DataFrame, tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """name and the tag it means: a tag of that name (through alias_of, one hop), else what the alias table says."""
    t = tags.select(F.lower("name").alias("_n"), F.coalesce("alias_of", "id").alias("_direct")).groupBy("_n").agg(F.min("_direct").alias("_direct"))
    a = aliases.select(F.lower("from_name").alias("_f"), "tag_id").groupBy("_f").agg(F.min("tag_id").alias("_alias"))
    met = wanted.join(t, F.lower("name") == F.col("_n"), "left").join(a, F.lower("name") == F.col("_f"), "left")
    return met.select("name", F.coalesce("_direct", "_alias").alias("tag_id"))


def merge_snapshots(remote: DataFrame, local: DataFrame, key: str, time: str = "updated_at", deleted: str = "deleted_at") -> DataFrame:
    """The newer row of each key from two snapshots of one table; on equal times a deletion wins, then the local row."""
    both = remote.withColumn("_side", F.lit(0)).unionByName(local.withColumn("_side", F.lit(1)))
    w = W.partitionBy(key).orderBy(F.greatest(time, deleted).desc_nulls_last(), F.col(deleted).isNotNull().desc(), F.col("_side").desc())
    return both.withColumn("_p", F.row_number().over(w)).filter("_p = 1").drop("_p", "_side")


def ordered_union(sources: Sequence[DataFrame], key: Sequence[str], limit: int, per: Sequence[str] = ()) -> DataFrame:
    """The first `limit` distinct keys (of each `per`) in the order of the sources, then of their `place`.

    A key counts where it comes first.
    """
    union = None
    for i, s in enumerate(sources):
        row = s.select(*key, F.lit(i).alias("_s"), "place")
        union = row if union is None else union.unionByName(row)
    first = union.groupBy(*key).agg(F.min(F.struct("_s", "place")).alias("_o"))
    if not per:
        first = first.orderBy("_o", *key).limit(limit)
    place = F.row_number().over((W.partitionBy(*per) if per else W.partitionBy(F.lit(0))).orderBy("_o", *key))
    return first.select(*key, place.alias("place")).filter(F.col("place") <= limit)


def restructure(nodes: DataFrame, entries: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies a log of tree operations (seq, op, id, target): rename, move, and delete into `target` or the root.

    The last operation of a kind on a node counts; moves below oneself are refused. Children and entries of a deleted
    node go to its target. Returns (nodes, entries).
    """
    from quern.operators.trees import would_cycle

    last = ops.groupBy("op", "id").agg(F.max_by("target", "seq").alias("target"))
    moves = last.filter("op = 'move'").select("id", F.col("target").alias("parent_id"))
    fine = would_cycle(nodes, moves).filter("NOT cycle").select(F.col("id").alias("_m"), F.col("parent_id").alias("_to"))
    names = last.filter("op = 'rename'").select(F.col("id").alias("_r"), F.col("target").alias("_name"))
    gone = last.filter("op = 'delete'").select(F.col("id").alias("_d"), F.col("target").alias("_into"))
    out = nodes.join(fine, F.col("id") == F.col("_m"), "left").join(names, F.col("id") == F.col("_r"), "left")
    out = out.select("id", F.when(F.col("_m").isNotNull(), F.col("_to")).otherwise(F.col("parent_id")).alias("parent_id"), F.coalesce("_name", "name").alias("name"), "deleted")
    out = out.join(gone.toDF("_pd", "_pinto"), F.col("parent_id") == F.col("_pd"), "left").join(gone.select("_d"), F.col("id") == F.col("_d"), "left")
    out = out.select("id", F.when(F.col("_pd").isNotNull(), F.col("_pinto")).otherwise(F.col("parent_id")).alias("parent_id"), "name", (F.col("deleted") | F.col("_d").isNotNull()).alias("deleted"))
    placed = entries.join(gone, F.col("catalog_id") == F.col("_d"), "left")
    placed = placed.withColumn("catalog_id", F.when(F.col("_d").isNotNull(), F.col("_into")).otherwise(F.col("catalog_id"))).drop("_d", "_into")
    return out, placed
