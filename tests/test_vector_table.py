"""A refreshed table of vectors against one built anew."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from quern.operators import vector_table

COLUMNS = "file_id long, entry_id long, section_id string, text_hash string, text string"


def test_refresh_equals_rebuild(spark, tmp_path):
    rng = random.Random(4)
    asked = spark.sparkContext.accumulator(0)

    def embed(rows):
        def per_batch(frames):
            for f in frames:
                asked.add(len(f))
                yield f.assign(vector=[[float(len(t)), 1.0] for t in f["text"]]).drop(columns="text")

        return rows.mapInPandas(per_batch, "bucket int, file_id long, entry_id long, section_id string, text_hash string, vector array<double>")

    def frame(state):
        rows = [(f, e, s, t and f"h{t}", t or "") for (f, e, s), t in state.items()]
        return spark.createDataFrame(rows + rows[:2], COLUMNS).select("file_id", "entry_id", "section_id", "text_hash", "text")

    state = {(f if f else None, 10 * f + e, f"s{e}" if e else None): f"text {rng.randrange(30)}" for f in range(20) for e in range(3)}
    state[(4, 40, "none")] = None
    folder, other = str(tmp_path / "kept"), str(tmp_path / "anew")
    listed = lambda at: sorted((str(tuple(r)) for r in vector_table.read(spark, at).select("bucket", *vector_table.KEYS, "vector").collect()))
    times = lambda: {d: max(os.stat(f"{folder}/{d}/{n}").st_mtime_ns for n in os.listdir(f"{folder}/{d}")) for d in os.listdir(folder) if d.startswith("bucket=")}
    vector_table.build(frame(state), embed, folder, 8)
    alone = vector_table.read(spark, folder).groupBy("bucket").agg(F.collect_set("file_id").alias("f")).collect()
    gone = set(min((r.f for r in alone), key=len))
    for batch in range(3):
        before, stamps, had = dict(state), times(), asked.value
        if batch == 0:
            state = {k: v for k, v in state.items() if k[0] not in gone}  # a whole bucket goes
        elif batch == 1:
            state[(3, 31, "s1")], state[(99, 990, None)] = "a new text", "text 1"
        vector_table.refresh(frame(state), embed, folder, 8)
        assert asked.value - had <= (3 if batch == 1 else 2), "known texts keep their vectors"
        stayed = [d for d, t in times().items() if stamps.get(d) == t]
        assert len(stayed) >= (len(stamps) if before == state else len(stamps) - 4)
        vector_table.build(frame(state), embed, other, 8)
        assert listed(folder) == listed(other), batch
