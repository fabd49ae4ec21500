"""Running values, frames, and joins on time, against plain versions."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import intervals
from quern.plans import ordered


@pytest.fixture
def rows(spark):
    rng = random.Random(2)
    made = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(9)]), i, rng.choice([None, 1, 2, 5])) for i in range(300)] + [("n", 1, 900, None)]
    return made, spark.createDataFrame(made, "g string, t int, id int, v int").repartition(7)


def order_of(row):
    return (row[1] is not None, row[1] or 0, row[2])


def test_running_sums_and_last_values(rows):
    made, frame = rows
    got = ordered.running(frame, ["g"], ["t", "id"], {"s": F.col("v"), "w": F.col("v") * 2}, count="n")
    last = ordered.last_values(frame, ["g"], ["t", "id"], F.col("v"), "last")
    want, lasts = set(), set()
    for g in {r[0] for r in made}:
        total, seen = None, None
        for n, r in enumerate(sorted((r for r in made if r[0] == g), key=order_of), 1):
            total = total if r[3] is None else (total or 0) + r[3]
            seen = seen if r[3] is None else r[3]
            want.add((*r, total, None if total is None else 2 * total, n))
            lasts.add((*r, seen))
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in last.collect()} == lasts
    whole = ordered.running(frame, [], ["t", "id"], {}, count="n")
    assert {(r.id, r.n) for r in whole.collect()} == {(r[2], n) for n, r in enumerate(sorted(made, key=order_of), 1)}
    assert ordered.running(frame.filter("false"), ["g"], ["t", "id"], {"s": F.col("v")}).count() == 0


def test_groups_frame(rows):
    made, frame = rows
    got = {(r.g, r.t, r.id, r.total, r.lines, r["rank"]) for r in ordered.groups_frame(frame, ["g"], "t", F.col("v"), 2, "total", "lines", "rank").collect()}
    want = set()
    for g in {r[0] for r in made}:
        own = [r for r in made if r[0] == g]
        times = sorted({r[1] for r in own}, key=lambda t: (t is not None, t or 0))
        for r in own:
            at = times.index(r[1])
            inside = [x for x in own if x[1] in times[max(0, at - 2) : at + 1]]
            values = [x[3] for x in inside if x[3] is not None]
            want.add((g, r[1], r[2], sum(values) if values else None, len(inside), at + 1))
    assert got == want


def test_overlaps_meet_once(spark):
    rng = random.Random(7)
    span = lambda i, hot: (rng.choice([1, 1, 1, 2, None]), s := rng.randrange(-300, 300), None if i % 50 == 3 else s + rng.choice([-1, 0, 1, 5, 40, hot]), i)
    left, right = [span(i, 900) for i in range(150)], [span(i, 3) for i in range(150)]
    a, b = spark.createDataFrame(left, "k int, ls long, le long, lid int"), spark.createDataFrame(right, "k int, rs long, re long, rid int")
    good = lambda rows: [r for r in rows if r[0] is not None and r[2] is not None and r[1] <= r[2]]
    want = sorted((x[0], x[3], y[3]) for x in good(left) for y in good(right) if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    for width in (1, 10):
        got = intervals.overlap_join(a, b, ["k"], ("ls", "le"), ("rs", "re"), width)
        assert sorted((r.k, r.lid, r.rid) for r in got.collect()) == want and len(want) > 500
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_short_spans_of_one_key_never_meet_in_wide_bins(spark):
    """40 000 spans on each side of one key, three days apart: all pairs are 1.6 billion for each level of bins."""
    side = lambda name, n: spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 3).alias(f"{name}s"), (F.col("id") * 3 + 1).alias(f"{name}e"), F.col("id").alias(f"{name}id"))
    long = spark.createDataFrame([(1, 0, 90_000, -1)], "k int, rs long, re long, rid long")
    got = intervals.overlap_join(side("l", 40_000), side("r", 40_000).union(long), ["k"], ("ls", "le"), ("rs", "re"), 4)
    start = time.monotonic()
    assert got.filter("rid >= 0").count() == 40_000 and got.filter("rid < 0").count() == 30_001
    assert time.monotonic() - start < 60


def test_asof_join(spark):
    left = spark.createDataFrame([("u", 5, 1, "x"), ("u", 1, 2, "y"), ("w", 9, 3, "z"), (None, 9, 4, "n")], "k string, at int, id int, keep string")
    right = spark.createDataFrame([("u", 5, 7, 70), ("u", 4, 8, 80), ("u", 3, 9, None), ("w", 10, 10, 1), (None, 2, 11, 5)], "k string, at int, id int, v int")
    got = {r.id: r.v for r in intervals.asof_join(left, right, ["k"], "at", "id", F.col("v"), "v").collect()}
    assert got == {1: 70, 2: None, 3: None, 4: 5}
    # the last value counts, though it is null
    assert intervals.asof_join(left, right.filter("id = 8 OR id = 9").withColumn("at", F.col("at") + F.when(F.col("id") == 9, 2).otherwise(0)), ["k"], "at", "id", F.col("v"), "v").filter("id = 1").first().v is None
