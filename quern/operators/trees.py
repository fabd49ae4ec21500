"""Trees kept as parent references, of any depth: each round doubles how far up every node is known.

A round joins the table of jumps (a node and the one 2^k above it) with itself and with what has been found, so a chain
of n nodes takes about log2(n) rounds. Jumps are at most a row a node; what is found is no larger than the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.lineage import written


def _doubled(jumps: DataFrame) -> DataFrame:
    above = jumps.select(F.col("id").alias("up"), F.col("up").alias("_up"))
    return written(jumps.join(above, "up").select("id", F.col("_up").alias("up")))


def _closed(found: DataFrame, more: DataFrame, keys: list[str], distance: str) -> tuple[DataFrame, int]:
    """Both, each pair at its least distance, and how many pairs there are."""
    rows = written(found.union(more).groupBy(*keys).agg(F.min(distance).alias(distance)))
    return rows, rows.count()


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id and depth of every live node below each root, the root included.

    `nodes` has id, parent_id and deleted. A node in a cycle is below every node of it, once.
    """
    live = written(nodes.filter("NOT deleted").select("id", "parent_id"))
    jumps = written(live.join(live.select(F.col("id").alias("up")), F.col("parent_id") == F.col("up")).select("id", "up"))
    keys = ["root", "id"]
    found = written(roots.select("id").distinct().join(live.select("id"), "id").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")))
    n, reach = found.count(), 1
    while not jumps.isEmpty():
        below = jumps.join(found.select("root", F.col("id").alias("up"), "depth"), "up").select("root", "id", (F.col("depth") + reach).alias("depth"))
        found, now = _closed(found, below, keys, "depth")
        # what lies further up has a way through what is nearer, so nothing new now means nothing new ever
        if now == n:
            break
        jumps, reach, n = _doubled(jumps), reach * 2, now
    return found.select("root", "id", "depth")


def ancestors(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, ancestor and distance (0 for itself) for every seed; deleted ancestors included, cycles end."""
    links = written(nodes.select("id", F.col("parent_id").alias("up")))
    jumps = links.filter("up IS NOT NULL")
    found = written(seeds.select("id").distinct().join(links.select("id").distinct(), "id").select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")))
    n, reach = found.count(), 1
    while not jumps.isEmpty():
        further = found.join(jumps.select(F.col("id").alias("ancestor"), "up"), "ancestor").select("id", F.col("up").alias("ancestor"), (F.col("distance") + reach).alias("distance"))
        found, now = _closed(found, further, ["id", "ancestor"], "distance")
        if now == n:
            break
        jumps, reach, n = _doubled(jumps), reach * 2, now
    return found.select("id", "ancestor", "distance")


def paths(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """id and its path of names from the root."""
    chain = ancestors(nodes, seeds).join(written(nodes.select(F.col("id").alias("ancestor"), "name")), "ancestor")
    steps = chain.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), "name"))).alias("_s"))
    return steps.select("id", F.array_join(F.transform("_s", lambda s: s["name"]), "/").alias("path"))


def would_cycle(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """For each move (id, parent_id): whether the new parent lies at or below the node."""
    up = ancestors(nodes, moves.select(F.col("parent_id").alias("id")).distinct()).select(F.col("id").alias("parent_id"), F.col("ancestor").alias("id"), F.lit(True).alias("_c"))
    return moves.join(up, ["id", "parent_id"], "left").select("id", "parent_id", F.coalesce("_c", F.lit(False)).alias("cycle"))


def nearest_live(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """id and its nearest ancestor that isn't deleted, itself included."""
    up = ancestors(nodes, seeds).join(written(nodes.filter("NOT deleted").select(F.col("id").alias("ancestor"))), "ancestor")
    return up.groupBy("id").agg(F.min_by("ancestor", "distance").alias("ancestor"))
