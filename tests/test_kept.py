"""Kept results against those made anew."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quern.operators import kept
from quern.operators.components import connected_components
from tests.oracle import SF


def test_components_after_each_batch(spark):
    rng = random.Random(6)
    frame = lambda rows: spark.createDataFrame(sorted(rows), "a long, b long")
    rows_of = lambda df: sorted(tuple(r) for r in df.select("node", "component").collect())
    edge = lambda: (rng.randrange(80), rng.randrange(80))
    edges = {edge() for _ in range(45)} | {(200, 201), (201, 202), (202, 203)}
    labels = connected_components(frame(edges))
    for batch in range(3):
        added = {edge() for _ in range(8)} - edges
        removed = set(rng.sample(sorted(edges), 4)) | ({(201, 202)} if batch == 1 else set())
        removed &= edges
        edges = (edges - removed) | added
        labels = kept.update_components(labels, frame(edges), frame(added), frame(removed) if batch else None) if batch else kept.update_components(labels, frame(edges | removed), frame(added))
        edges = edges if batch else edges | removed
        assert rows_of(labels) == rows_of(connected_components(frame(edges))), batch
    assert rows_of(kept.update_components(labels, frame(edges), frame({(5, 5)}))) == rows_of(labels)


def test_states_as_of_any_version(spark):
    rng = random.Random(8)
    state = {i: rng.randrange(5) for i in range(60)}
    frame = lambda s: spark.createDataFrame(sorted(s.items()), "id int, v int")
    base, states, log = frame(state), [dict(state)], None
    for version in (1, 2, 3):
        after = {i: (rng.randrange(5) if rng.random() < 0.3 else v) for i, v in states[-1].items() if rng.random() > 0.1} | {100 * version + n: n for n in range(3)}
        if version == 3:
            after[0] = 9  # comes back, or changes
        change = kept.changes_of(frame(states[-1]), frame(after), "id", version)
        log = change if log is None else log.unionByName(change)
        states.append(after)
    for version, want in enumerate(states):
        assert sorted((r.id, r.v) for r in kept.as_of(base, log, "id", version).collect()) == sorted(want.items())
    assert kept.changes_of(base, base, "id", 9).count() == 0


def test_sketches_add_up(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    hours = kept.summaries(events)
    days = kept.merged(hours, "day")
    months = kept.told(kept.merged(days, "month"))
    exact = {(r.start, r.event_type): r for r in events.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.sort_array(F.collect_list("value")).alias("v"), F.min("ts").alias("first")).collect()}
    got = months.collect()
    assert len(got) == len(exact)
    for r in got:
        e = exact[r.start, r.event_type]
        assert (r.n, r["first"]) == (e.n, e["first"]) and abs(r.users - e.users) <= max(1, 0.05 * e.users)
        for share, value in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            below, upto = sum(x < value for x in e.v) / len(e.v), sum(x <= value for x in e.v) / len(e.v)
            assert below - 0.02 <= share <= upto + 0.02
