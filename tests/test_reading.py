"""Members of containers, plain indexes and related hits against brute force and odd rows."""

from __future__ import annotations

import fnmatch
import json
import re

from pyspark.sql import functions as F

from quern.operators import answers, graph, members


def test_shell_patterns(spark):
    paths = ["a/b/c.py", "a/c.py", "x[1].txt", "x1.txt", "-", "a-c", "b", "]", "!", "^", "a&&b", "", "é", "a\\b", "z.py\n"]
    patterns = ["*", "a/*.py", "**/*.py", "?", "[a-c]", "[!a-c]", "[c-a]", "[!c-a]", "x[[]1].txt", "[", "[]]", "[]", "[!]", "[!]]", "[^b]", "[a&&b]*", "a\\b", "[a-]", "[-a]", "x[12].txt"]
    rows = spark.createDataFrame([(p, g, members.shell_regex(g)) for p in paths for g in patterns], "p string, g string, r string")
    for r in rows.withColumn("ok", F.regexp_like("p", F.col("r"))).collect():
        assert r.ok == fnmatch.fnmatchcase(r.p, r.g), r


def test_listing(spark):
    held = spark.createDataFrame([("c", i, f"d{i % 3}/{i}.txt", i) for i in range(1500)] + [("o", 1, "only", 7), (None, 1, "lost", 1)], "container string, position int, path string, size long")
    asked = [(1, "c", None, None, None), (2, "c", "", 0, -5), (3, "c", "d1/*", 5000, 10), (4, "c", "*7.txt", 3, 149), (5, "c", "none*", 5, 0), (6, "gone", None, 5, 0), (7, "o", "on?y", 1, 0), (8, "c", None, 10, 1495), (9, "c", None, 10, 9000), (10, None, None, 5, 0), (11, "c", None, -3, 2)]
    got = {r.request: r for r in members.listing(held, spark.createDataFrame(asked, "request int, container string, glob string, limit int, offset int").withColumn("size", F.lit("clash"))).collect()}
    for request, container, glob, limit, offset in asked:
        found = [(f"d{i % 3}/{i}.txt", i) for i in range(1500)] if container == "c" else [("only", 7)] if container == "o" else []
        found = [f for f in found if not glob or fnmatch.fnmatchcase(f[0], glob)]
        offset, limit = max(0, offset or 0), max(0, min(limit or 200, 1000))
        page, r = found[offset : offset + limit], got[request]
        assert [tuple(m) for m in r.matches] == page and r["count"] == len(page) and r.total == len(found), request
        assert r.has_more == (len(found) > offset + len(page)) and r.next_offset == (offset + len(page) if r.has_more else None), request
    assert members.listing(held.limit(0), spark.createDataFrame(asked[:1], "request int, container string, glob string, limit int, offset int")).first().total == 0


def test_reads(spark):
    texts = {"a": "one\r\ntwo\rthree\x0bfour five\n", "b": "äöü€😀x", "c": "", "d": None, "e": "x" * 40_000}
    values = [("lines", "2-3"), ("lines", "0-1"), ("lines", " 2 - 9 "), ("lines", "4-2"), ("lines", "2"), ("lines", "-1-2"), ("lines", "1-99999999999"), ("lines", "0001-00002"), ("bytes", "0-0"), ("bytes", "1-8"), ("bytes", "3-10"), ("bytes", "5-2"), ("bytes", "90-99"), ("bytes", None), ("whole", "x"), (None, None), ("pages", "1-2")]
    asked = [(f"{p}{i}", "k", p, u, v) for p in texts for i, (u, v) in enumerate(values)] + [("no", "k", "zz", "lines", "1-2"), ("null", None, None, None, None)]
    held = spark.createDataFrame([("k", p, t) for p, t in texts.items()], "container string, path string, text string")
    got = {r.request: r for r in members.read(held, spark.createDataFrame(asked, "request string, container string, path string, unit string, value string").withColumn("text", F.lit("clash"))).collect()}
    assert got["no"].error == got["null"].error == "path not found in container" and len(got) == len(asked)
    for request, _, path, unit, value in asked[:-2]:
        text, r = texts[path] or "", got[request]
        m = re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", value or "")
        if unit in ("lines", "bytes") and not m:
            assert r.text is None and r.line_count is None and r.error == "value must be 'start-end'"
        elif unit == "lines":
            lines = text.splitlines()[max(1, int(m[1])) - 1 : int(m[2])]
            assert (r.text, r.line_count, r.error) == ("\n".join(lines), len(lines), None), request
        elif unit == "bytes":
            assert (r.text, r.error) == (text.encode()[int(m[1]) : int(m[2]) + 1].decode("utf-8", "replace"), None), request
        elif unit == "pages":
            assert (r.text, r.error) == (None, "unknown unit")
        else:
            assert (r.text, r.error) == (text[:32_000], None)


def test_coverage_and_plain_index(spark):
    given = ['{"coverage": {"unit": "lines", "x": 1, "sampled": null, "total_rows": 2.5, "partial_reasons": ["a"]}}', '{"coverage": {"x": 1}}', '{"coverage": []}', '{"coverage": {}}', "[]", "no", "", None, "{}"]
    out = [r[0] for r in spark.createDataFrame([(g,) for g in given], "d string").select(answers.compact_coverage(F.col("d"))).collect()]
    assert json.loads(out[0]) == {"unit": "lines", "sampled": None, "total_rows": 2.5, "partial_reasons": ["a"]} and out[1:] == [None] * 8
    docs = [(1, "x\n" * 30_000, "text", "Deploy.txt", None, None), (2, None, None, None, None, None), (3, " \n ", "log", "", "", ""), (4, "security " + "y" * 5000 + " incident", None, None, "t/support", None), (5, "z" * 60_000, "text", None, None, None)]
    rows = answers.plain_index(spark.createDataFrame(docs, "doc_id int, text string, kind string, name string, mime string, ext string").withColumn("_id", F.lit(0)).drop("_id"))
    got = {r.doc_id: r for r in rows.collect()}
    tags = {k: [f"{t.facet}:{t.name}" for t in r.tags] for k, r in got.items()}
    assert tags == {1: ["topic:deploy", "form:text"], 2: ["form:document"], 3: ["form:log"], 4: ["topic:security", "topic:support"], 5: ["form:text"]}
    assert {k: (r.chunk_count, r.chunked, r.anchor) for k, r in got.items()} == {1: (2, True, "1-30000"), 2: (1, False, "1-1"), 3: (1, False, "1-2"), 4: (1, False, "1-1"), 5: (1, False, "1-1")}
    assert got[2].summary == "No  content extracted." and got[3].summary == "No log content extracted." and len(got[5].summary) == 500


def test_related(spark):
    edges = spark.createDataFrame([(1, 2, 5), (1, 3, 1), (3, 4, 1)], "a long, b long, observation_count long")
    entries = spark.createDataFrame([(i, f"e{i}") for i in (1, 2, 3)], "entry_id long, display_name string")
    hits = spark.createDataFrame([(1, 1, "x"), (9, 2, "x"), (4, 3, "x"), (3, 4, "x")], "entry_id long, place int, display_name string")
    got = {r.entry_id: [(x.entry_id, x.display_name) for x in r.related] for r in graph.with_related(hits, edges, entries, prefill=3, most=2).collect()}
    assert got == {1: [(2, "e2"), (3, "e3")], 9: [], 4: [(3, "e3"), (1, "e1")], 3: []}
    assert graph.with_related(hits.limit(0), edges, entries).count() == 0
