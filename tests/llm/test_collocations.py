"""Collocations against SQL over the given documents and a plain version over odd ones."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import collocations, queries
from tests.oracle import SF, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, max_words, least, percent, top):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p for p, a in f.items() if a >= least and len(p) > 1}
        rows = []
        for p in found:
            holds = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(holds(q) and 100 * f[q] >= percent * f[p] for q in found):
                continue
            score, k = min((1000000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture
def docs():
    rng = random.Random(3)
    words = ["the", "New", "york", "é", "A b", "漢字", "x\x00y", "red", "wine", "of", "-"]
    said = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n"]) for _ in range(rng.randrange(40)))
    rows = [(said() + "New York city, red wine of the" * rng.randrange(3), rng.choice(["en", "fr", None, "und", ""])) for _ in range(150)]
    return [*rows, (None, "en"), ("", None), ("alone", "xx"), ("hot pair " * 4000, "en"), ("a.b c", "en"), ("a.b c", "en")]


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_against_plain(spark, monkeypatch, docs, max_words):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 2000)
    monkeypatch.setattr(collocations, "PART_BYTES", 100)
    monkeypatch.setattr(collocations, "LEAST_BUCKETS", 5)
    frame = spark.createDataFrame(docs, "text string, lang string").select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("slice"), F.lit(2).alias("f")).repartition(3)
    got = collocations.collocations(frame, max_words=max_words, min_count=4, cover_percent=50, top=30)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(docs, max_words, 4, 50, 30)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_registered_query(spark):
    same(queries.op11_collocations(spark, SF), queries.oracle_sql()["op11_collocations"])
