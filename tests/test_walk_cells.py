"""Walks whose blocks and cells are many, against one step after the other in plain Python."""

from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from quern.binding import Store
from quern.operators import graph
from quern.plans.lineage import shared_dir


def test_walk_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_MOVES", 60)
    monkeypatch.setattr(graph, "CELL_WAYS", 40)
    monkeypatch.setattr(graph, "ROW_MOVES", 3, raising=False)
    rng = random.Random(9)
    weights = {(a, b): rng.randrange(1, 9) for a, b in {tuple(sorted(rng.sample(range(80), 2))) for _ in range(200)}}
    asked = [0, 7, 33, 79, 500]  # the last has no way on
    ways = defaultdict(dict)
    for (a, b), w in weights.items():
        ways[a][b] = ways[b][a] = w
    want = defaultdict(float)
    for seed in asked:
        mass = {seed: 1.0}
        for _ in range(graph.STEPS):
            moved = defaultdict(float)
            for node, p in mass.items():
                for to, w in ways[node].items():
                    moved[to] += p * w / sum(ways[node].values()) * (1 - graph.RESTART)
            moved[seed] += 1 - sum(moved.values())
            mass = moved
            for node, p in mass.items():
                want[seed, node] += p * (node != seed)
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "a long, b long, observation_count long")
    got = graph.expected_walk(edges, spark.createDataFrame([(i,) for i in asked], "id long")).collect()
    assert {(r.seed, r.node): r.visits for r in got} == pytest.approx({k: v for k, v in want.items() if v})


def test_walk_leaves_one_table_and_no_shuffles(spark):
    """Every step's tables and shuffles stayed on disk, 13 checkpoints and 8 tables for six steps."""
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(50)], "a long, b long, observation_count long")
    seeds = spark.createDataFrame([(3,), (20,)], "id long")
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_(\d+)_", blocks.getAllFiles().mkString(",")))
    at = Path(shared_dir(spark).removeprefix("file://"))
    tables = lambda: set(at.glob("quern/*")) | set(at.glob("*/rdd-*"))
    tables_before, shuffles_before = tables(), shuffles()
    frame = graph.expected_walk(edges, seeds)
    assert len(tables() - tables_before) <= 1
    until = time.time() + 20
    while shuffles() - shuffles_before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - shuffles_before
    assert frame.count() > 10


def test_edges_move_the_lines_once(spark, tmp_path):
    rng = random.Random(3)
    lines = [(rng.choice([None, *range(30)]), rng.choice([None, *range(8)]), rng.choice([None, *range(1, 8)])) for _ in range(900)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = Store(spark, str(tmp_path)).edges
    met = {(o, a, b) for o, a, i in lines for p, b, j in lines if None not in (o, a, b, i, j) and o == p and i + 1 == j and a < b}
    assert {(r.a, r.b): r.observation_count for r in edges.collect()} == Counter((a, b) for _, a, b in met)
    plan = edges._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan


def test_walk_with_names(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("x", "y", None), (None, "a", 1)], "a string, b string, observation_count int")
    got = graph.expected_walk(edges, spark.createDataFrame([("a",), ("lost",), (None,)], "id string"), steps=2).collect()
    # one step: all to b; the next: two thirds of it back, a third on
    assert {(r.seed, r.node): round(r.visits, 9) for r in got} == {("a", "b"): round(0.85 + 0.15 * 0.85, 9), ("a", "c"): round(0.85 * 0.85 / 3, 9)}
