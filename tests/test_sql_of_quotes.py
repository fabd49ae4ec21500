"""Queries on quotes against their SQL, over texts that say a quote twice or otherwise written."""

from __future__ import annotations

from quern import catalogue
from tests.oracle import same


def _same(spark, name, rows, schema, table, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/made")
    part = next(folder.joinpath("made").glob("*.parquet"))
    (folder / "tables").mkdir()
    (folder / "tables" / f"{table}.parquet").write_bytes(part.read_bytes())
    same(catalogue.queries()[name](spark, str(folder / "tables")), catalogue.oracle_sql()[name], str(folder / "tables"))


def test_quoted_evidence_of_short_texts(spark, tmp_path):
    """The ends `n`, `end` and `st` are on the first or last page too."""
    texts = ["Then in the n.", "Then in an end.", "The in the st", "Oh in the ß", "", "- . - . - . -", "ab", "The in a long text of words."]
    rows = [(i, texts[i % 21 % len(texts)], "en", "s", len(texts[i % 21 % len(texts)])) for i in range(21 * 8)]
    _same(spark, "d19_quoted_evidence", [(i, texts[(i + i // 21) % len(texts)], *r[2:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long", "documents", tmp_path)


def test_first_page_of_a_quote_written_otherwise(spark, tmp_path):
    rows = [(1, 0, "user", "He said: STRASSE no-one"), (1, 1, "user", "x straße\nNo one"), (2, 0, "user", "none"), (2, 1, "user", "  - - -"), (3, 0, "user", "abc"), (3, 1, "user", "zzAbc"), (4, 0, "user", None), (4, 1, "user", "zzAbc")]
    _same(spark, "x20_first_page", rows, "conv_id long, turn long, role string, text string", "conversations", tmp_path)
