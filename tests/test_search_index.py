"""Pruned search against scoring every entry, and how much of the index it reads."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quern.operators import retrieval, search_index


def test_pruned_search_equals_full_scores(spark, monkeypatch):
    rng = random.Random(5)
    common, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(3000)]
    said = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n))
    texts = [(i, said(rng.randrange(5, 60))) for i in range(4000)] + [(9000, None), (9001, ""), (9002, "the the"), (-5, "w1 w1 w1 the")]
    texts = spark.createDataFrame(texts, "entry_id long, text string")
    queries = spark.createDataFrame([(1, "the w1 w2 w3"), (2, "of and"), (3, "nothing here"), (4, None), (5, "W7 w7 THE"), (6, " ".join(rare[:40]))], "query_id long, text string")
    index = search_index.open_index(spark, search_index.build(texts).folder)
    for k in (1, 10, 500):
        got = search_index.search(index, queries, k)
        want = retrieval.ranked(retrieval.bm25(texts, queries), k, "rank", keep=("score",))
        rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "entry_id", "score", "rank").collect())
        assert rows(got.results) == rows(want)
    monkeypatch.setattr(search_index, "RANGE", 4)
    few = search_index.search(search_index.build(texts), queries.filter("query_id IN (1, 5)"), 3)
    read = {r["read"]: r.n for r in few.ranges.groupBy("read").agg(F.sum("blocks").alias("n")).collect()}
    assert read[False] > 20 * read[True]
    assert search_index.search(search_index.build(texts.filter("false")), queries, 3).results.count() == 0


def test_a_cell_passes_on_the_best_alone(spark, monkeypatch):
    monkeypatch.setattr(search_index, "LANE", 2)
    texts = spark.createDataFrame([(i, "the same word " + str(i)) for i in range(600)], "entry_id long, text string").coalesce(1)
    index = search_index.build(texts)
    asked = search_index._asked(spark.createDataFrame([(1, "the word"), (2, "same 7")], "query_id long, text string"), index)
    ranges = asked.join(index.tops, "term").select("query_id", "range").distinct()
    lanes = -(-index.tops.select("range").distinct().count() // 2)
    found = search_index._scores(asked, index, ranges, 3)
    # before, every entry that shares a term was a row for each query
    assert 6 <= found.count() <= 2 * 3 * lanes
    assert {(r["query_id"], r["entry_id"]) for r in found.collect()} >= {(1, 0), (1, 1), (1, 2), (2, 7)}
