"""The near-dedup stage takes candidates from SimHash balls, and texts decide."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quern.llm import near_copies, simhash
from quern.plans.rows import numbered


def test_balls_propose_without_bands(spark):
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n))
    base, other = said(900), said(900)
    texts = [(1, base), (2, base + " end"), (3, other), (4, None), (5, "")]
    apart = simhash.fingerprint(base.encode(), near_copies.SHINGLE) ^ simhash.fingerprint((base + " end").encode(), near_copies.SHINGLE)
    assert apart.bit_count() <= simhash.RADIUS
    docs = numbered(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text")
    rows = near_copies._signatures(docs)
    # before, a text had keys of bands alone, so nothing was found without them
    distinct = rows.groupBy("high", "low").agg(F.min("_row").alias("node"), F.first("fp").alias("fp"))
    distinct = distinct.select("node", "fp", F.array().cast("array<long>").alias("keys"))
    ids = {r["_row"]: r["doc_id"] for r in docs.collect()}
    assert [{ids[r["a"]], ids[r["b"]]} for r in near_copies._links(docs, distinct).collect()] == [{1, 2}]
