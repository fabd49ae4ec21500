"""Repeated passages against plain versions that look at every window of every text."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import queries, repeats
from quern.llm.repeats import factor_flags, smaller_positions, suffix_ranks

SF = "/root/testdata/sf0.001"


def plain(docs, length, keep):
    """docs: (doc_id, text) in order; spans of removed bytes by place."""
    texts = [(t or "").encode() for _, t in docs]
    starts = defaultdict(list)
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            starts[t[p : p + length]].append((d, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in starts.values():
        for d, p in places if keep == "none" and len(places) > 1 else places[1:]:
            gone[d][p : p + length] = True
    out = []
    for (doc_id, _), t, g in zip(docs, texts, gone):
        spans = int(np.sum(np.diff(np.r_[0, g.astype(int)]) == 1))
        kept = bytes(np.frombuffer(t, np.uint8)[~g])
        out.append((doc_id, len(t), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame, length, keep):
    made = repeats.remove_repeats(frame, length, keep, digest_only=True)
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in made.collect()], key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120))
def test_suffix_order_and_smaller_positions(letters):
    letters = np.array(letters)
    ranks = suffix_ranks(letters, 8)
    lines = [tuple(letters[i : i + 8]) for i in range(len(letters))]
    order = {line: n for n, line in enumerate(sorted(set(lines)))}
    assert [order[line] for line in lines] == ranks.tolist()
    places = np.random.default_rng(len(letters)).permutation(len(letters))
    want = [next((j for j in range(i - 1, -1, -1) if places[j] < places[i]), -1) for i in range(len(places))]
    assert smaller_positions(places).tolist() == want
    earlier, other = factor_flags(ranks, places)
    assert earlier.tolist() == [any(lines[i] == lines[j] and places[j] < places[i] for j in range(len(lines))) for i in range(len(lines))]
    assert other.tolist() == [lines.count(line) > 1 for line in lines]


def texts(seed):
    rng = random.Random(seed)
    said = lambda n: "".join(rng.choices("abcdeé ", k=n))
    passage, page = said(70), said(200)
    docs = [None, "", "short", page, page, "x" * 150, "ab" * 90, page[20:150] + "!" + page[80:], said(300) + page[100:] + passage + passage]
    docs += [said(rng.randrange(60)) + passage + said(rng.randrange(60)) for _ in range(40)]
    docs += [said(20) + passage[i % 9 :] + said(i) for i in range(30)]
    return [(i, t) for i, t in enumerate(docs)] + [(3, page), (None, passage + "q" * 70)]


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("most", [1 << 12, 6])
def test_against_all_windows(spark, monkeypatch, keep, most):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    monkeypatch.setattr(repeats, "CHUNK", 128)
    docs = texts(most)
    frame = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit("clash").alias("TEXT"), F.lit(1).alias("_row")).repartition(5)
    # plain order: nulls first, then ids; equal rows are alike whichever comes first
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    assert got(frame, 50, keep) == plain(docs, 50, keep)


def test_tasks_follow_contexts(spark, monkeypatch):
    tasks, settled = [], repeats._settled

    def watched(items, *args):
        made = settled(items, *args)
        tasks.append((items.count(), made.rdd.getNumPartitions()))
        return made

    monkeypatch.setattr(repeats, "_settled", watched)
    monkeypatch.setattr(repeats, "TASK_CONTEXTS", 16, raising=False)
    docs = texts(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    assert got(frame, 50, "none") == plain(docs, 50, "none")
    # before, partitions were merged by their bytes, whatever the number of contexts
    assert tasks and all(contexts > 64 and n == -(-contexts // 16) for contexts, n in tasks)


def test_kept_bytes_and_empty_table(spark):
    made = repeats.remove_repeats(spark.createDataFrame([(1, "abcdefgh"), (2, "xxabcdefghyy")], "doc_id long, text string"), 6)
    assert {r.doc_id: bytes(r.kept) for r in made.collect()} == {1: b"abcdefgh", 2: b"xxyy"}
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 6).count() == 0


def test_registered_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted([tuple(r) for r in queries.op12_repeats(spark, SF).collect()], key=str)
    assert found == plain(docs, 400, "none")
    assert any(r[2] for r in found)
