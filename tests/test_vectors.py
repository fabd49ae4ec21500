"""Searches whose lanes and blocks lie in several partitions."""

from __future__ import annotations

import random

import pytest

from quern.operators import vectors


@pytest.fixture
def apart(spark):
    """No partition is merged with another, as on tables of several hundred megabytes."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark
    spark.conf.unset(name)


def test_lanes_and_blocks_meet_across_partitions(apart, monkeypatch):
    monkeypatch.setattr(vectors, "LANE", 20)
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rng = random.Random(3)
    held = [(i, i % 7, [rng.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(4)]) for i in range(150)]
    records = apart.createDataFrame(held, "entry_id long, section_id long, vector array<double>")
    asked = {i: v for i, _, v in held if i % 10 == 0}
    queries = apart.createDataFrame(list(asked.items()), "query_id long, query array<double>")
    scores = {q: sorted((-sum(a * b for a, b in zip(v, w)), i) for i, _, w in held) for q, v in asked.items()}
    got = {(r.query_id, r["rank"]): (-r.score, r.entry_id) for r in vectors.search(records, queries, 5).collect()}
    assert got == {(q, n): s for q, best in scores.items() for n, s in enumerate(best[:5], 1)}
    sections = {(r.query_id, r.entry_id) for r in vectors.best_sections(records, queries, 1.0).collect()}
    assert sections == {(q, i) for q, best in scores.items() for s, i in best if s <= -1.0}
