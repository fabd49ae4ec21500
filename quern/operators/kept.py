"""Results that are kept up to date: components under new and deleted edges, snapshots under a log of changes, sketches of
hours that add up to days and months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.plans.lineage import written


def update_components(labels: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """`labels` (node, component: its smallest node) after edges (a, b) were added and removed.

    `edges` are all edges after the change; it is read only where edges were removed. New edges link whole components, so
    only components that a new edge meets are solved again, as single nodes. A removed edge opens its own component:
    its remaining edges are solved anew, and nodes without any edge have no label.
    """
    ends = lambda rows: rows.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    proper = lambda rows: rows.select("a", "b").filter("a <> b")
    if removed is not None:
        opened = labels.join(ends(proper(removed)), "node", "left_semi").select("component").distinct()
        inside = labels.join(opened, "component", "left_semi").select("node")
        # only edges between old nodes of opened components; new edges come below
        old = proper(edges).join(inside.select(F.col("node").alias("a")), "a", "left_semi").join(inside.select(F.col("node").alias("b")), "b", "left_semi")
        labels = written(labels.join(opened, "component", "left_anti").select("node", "component").union(connected_components(old)))
    fresh = written(proper(added))  # read three times
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    met = fresh.join(of("a"), "a", "left").join(of("b"), "b", "left")
    links = written(met.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = connected_components(links).select(F.col("node").alias("_old"), F.col("component").alias("_new"))
    known = labels.join(moved, labels["component"] == moved["_old"], "left").select("node", F.coalesce("_new", "component").alias("component"))
    unknown = ends(fresh).join(labels.select("node"), "node", "left_anti")
    born = unknown.join(moved, unknown["node"] == moved["_old"], "left").select("node", F.coalesce("_new", "node").alias("component"))
    # a link between two nodes of one component moves nothing
    return written(known.union(born))


def as_of(base: DataFrame, changes: DataFrame, key: str, version: int) -> DataFrame:
    """`base` with the changes up to a version: of each key the last one, where a tombstone takes the row out.

    `changes` has the columns of `base`, version, and deleted. Keys that no change names keep their row, so only changed keys
    are ranked.
    """
    last = W.partitionBy(key).orderBy(F.col("version").desc(), F.col("deleted").desc())
    newest = changes.filter(F.col("version") <= version).withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    untouched = base.join(newest.select(key), key, "left_anti").select(*base.columns)
    return untouched.unionByName(newest.filter("NOT deleted").select(*base.columns))


def changes_of(before: DataFrame, after: DataFrame, key: str, version: int) -> DataFrame:
    """What turns one state of a table into the next: new and changed rows, and tombstones of rows that are gone."""
    digest = lambda rows: F.xxhash64(F.to_json(F.struct(*[rows[c] for c in before.columns if c != key])))
    had = before.select(F.col(key).alias("_k"), digest(before).alias("_was"))
    kept = after.join(had, after[key] == had["_k"], "left").filter(F.col("_k").isNull() | (F.col("_was") != digest(after)))
    gone = before.join(after.select(key), key, "left_anti")
    mark = lambda rows, deleted: rows.select(*before.columns, F.lit(version).alias("version"), F.lit(deleted).alias("deleted"))
    return mark(kept, False).unionByName(mark(gone, True))


def summaries(events: DataFrame, unit: str = "hour") -> DataFrame:
    """start, event_type, n, first, last, users and values: counts of each hour (or other unit) with sketches of who and how much.

    `users` is a HyperLogLog of user_id, `amounts` a KLL of value; both merge without loss, so hours are kept and longer
    times are made of them.
    """
    rows = events.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("start"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.hll_sketch_agg("user_id", F.lit(12)).alias("users"), F.kll_sketch_agg_double("value", F.lit(400)).alias("amounts"))


def merged(rows: DataFrame, unit: str) -> DataFrame:
    """Summaries of a longer unit from those of a shorter one."""
    by = rows.groupBy(F.date_trunc(unit, "start").cast("timestamp_ntz").alias("start"), "event_type")
    return by.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("amounts").alias("amounts"))


def told(rows: DataFrame, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """What summaries say: n, first, last, about how many users, and about which values stand at the shares of all."""
    values = [F.kll_sketch_get_quantile_double("amounts", F.lit(float(q))).alias(f"p{round(100 * q)}") for q in shares]
    return rows.select("start", "event_type", "n", "first", "last", F.hll_sketch_estimate("users").alias("users"), *values)
