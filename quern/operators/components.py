"""Connected components of an edge table of any size."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.lineage import cut

#: Edges that a task solves at once.
CELL = 1 << 18


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, cell: int = CELL) -> DataFrame:
    """`node` and `component` (its smallest node) for every node of an undirected edge table.

    Edges are dealt over cells by ranges of their nodes, and each cell names its nodes by the smallest one that its own edges
    reach. Only names of nodes that several cells have are linked further: in one more cell where no more than `cell` links
    are left, in rounds over the whole table otherwise. So long paths of near nodes take no rounds. A hub's edges are
    dealt by their other end too; null ends and loops are left out.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    pairs, n = _counted(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    cells = max(edges.sparkSession.sparkContext.defaultParallelism, ceil(n / cell))
    named = cut(_named(pairs.repartitionByRange(cells, "u", "v"), cell))
    low = named.groupBy("u").agg(F.min("v").alias("_m"), F.max("v").alias("_n")).select(F.col("u").alias("node"), "_m", "_n")
    shared = low.filter("_m <> _n").select("node", F.col("_m").alias("_s"))
    links, n = _counted(named.join(shared, F.col("u") == F.col("node")).filter("v <> _s").select(F.col("v").alias("u"), F.col("_s").alias("v")).distinct())
    if not n:
        return low.select("node", F.col("_m").alias("component"))
    moved = (_named(links.coalesce(1), cell) if n <= cell else _rounds(links, max_rounds)).toDF("_u", "_c")
    return low.join(moved, low["_m"] == moved["_u"], "left").select("node", F.coalesce("_c", "_m").alias("component"))


def _named(pairs: DataFrame, cell: int) -> DataFrame:
    """Each node of a task's pairs with the smallest one reached; a task that has more than `cell` pairs solves them in turn."""
    schema = pairs.schema

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= cell:
                yield from _stars(held)
                held, rows = [], 0
        if rows:
            yield from _stars(held)

    return pairs.mapInArrow(solve, schema)


def _stars(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """u, v: every node of the edges (u, v) and the smallest node that they connect it with."""
    table = pa.Table.from_batches(batches)
    ends = np.concatenate([table.column(c).to_numpy() for c in ("u", "v")])
    nodes, at = np.unique(ends, return_inverse=True)
    u, v = at.reshape(2, -1)
    least = np.arange(len(nodes))
    while True:
        x, y = least[u], least[v]
        if (x == y).all():
            break
        # roots meet the smallest root beside them, then every node follows to its root
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != (further := least[least])).any():
            least = further
    kind = table.schema.field("u").type
    return pa.table({"u": pa.array(nodes, kind), "v": pa.array(nodes[least], kind)}).to_batches(1 << 16)


def _rounds(links: DataFrame, max_rounds: int) -> DataFrame:
    """u, v: nodes of the links and their component's smallest one, but that itself.

    Each round first links every node's larger neighbours to its smallest neighbour, then every node and its smaller
    neighbours to the smallest of them, until nothing moves: each node then points at the smallest one it can reach.
    The rounds grow with the logarithm of the longest path. A hub costs no more than its edges, since the smallest
    neighbour is a partial aggregate.
    """
    state, size = _measured(links)
    for _ in range(max_rounds):
        both = state.select("u", "v").union(state.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.filter("u <> v").distinct()

        low = large.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), "_m")
        small = large.join(low, F.col("u") == F.col("_u"))
        moved = small.filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        state, now = _measured(moved.union(low.select("_u", "_m")).toDF("u", "v").distinct())
        if now == size:
            return state
        size = now
    raise RuntimeError(f"no end after {max_rounds} rounds")


def _counted(pairs: DataFrame) -> tuple[DataFrame, int]:
    pairs = cut(pairs)
    return pairs, pairs.count()


def _measured(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written to the shared folder, and a digest that tells whether a round changed them."""
    pairs = cut(pairs)
    n, s = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return pairs, (n, s)
