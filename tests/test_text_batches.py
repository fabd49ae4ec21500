"""Texts that become objects one at a time give what whole batches gave."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import documents


def test_chunks_in_parts_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(documents, "CHUNK_CHARS", 10)
    texts = {(1 << 60) + i: "\n".join("x" * (n % 9) for n in range(i)) for i in range(1, 40)} | {None: "a\n\nb", -1: ""}
    docs = spark.createDataFrame([*texts.items(), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.chunk, r.first_line, r.last_line, r.text) for r in documents.chunks(docs, 12).collect())
    assert got == sorted((k or 0, *c) for k, t in texts.items() if t for c in documents.fold_lines(t, 12))
    assert documents.chunks(docs.filter("text IS NULL"), 12).count() == 0


def test_quotes_with_nulls(spark):
    rows = [("a B-c", "ABC", True), ("Straße", "STRASSE", True), ("abc", "- -", False), (None, "a", False), ("abc", None, False), ("abc", "abd", False)]
    docs = spark.createDataFrame(rows, "s string, q string, want boolean").coalesce(1)
    found = docs.select("want", documents.quote_in("s", "q").alias("found"), documents.plain("s").alias("plain"))
    assert all(r.want == r.found for r in found.collect())
    assert {r.plain for r in found.collect()} == {"abc", "strasse", None}
    # both take Arrow batches: no column of whole texts becomes objects at once
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString() and documents.quote_in.evalType == documents.plain.evalType == F.arrow_udf(lambda x: x, "string").evalType
