"""Parts of documents: chunks, headings, line windows, citations, quotes, mails, tables in text."""

from __future__ import annotations

import email
import email.policy
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from quern.operators.members import shell_regex

#: Characters of chunks that a task holds as objects, about, besides one text.
CHUNK_CHARS = 4 << 20
HEADING = r"^(#{1,6})\s+(.+?)\s*#*$"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 1) and text of every line; an empty document has none."""
    rows = docs.filter(F.length(text) > 0).select(key, F.posexplode(F.split(text, "\n")).alias("_at", "line"))
    return rows.select(key, (F.col("_at") + 1).alias("line_no"), "line")


def chunks(docs: DataFrame, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of whole lines of at most `budget` characters each, as many lines as fit; a longer line is a chunk of its own.

    Returns key, chunk (from 0), first_line, last_line (from 1) and text. Documents are folded one at a time.
    """
    kind = dict(docs.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, size = [], [], 0
            for i, t in enumerate(batch.column(1)):
                made = fold_lines(t.as_py(), budget)
                at += [i] * len(made)
                out += made
                size += sum(len(c[3]) for c in made)
                if size > CHUNK_CHARS:
                    yield packed(batch, at, out)
                    at, out, size = [], [], 0
            yield packed(batch, at, out)

    def packed(batch: pa.RecordBatch, at: list[int], out: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        columns = zip(*out) if out else ([], [], [], [])
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made], names=["k", "chunk", "first_line", "last_line", "text"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL AND t <> ''")
    return rows.mapInArrow(cut, f"k {kind}, chunk int, first_line int, last_line int, text string").withColumnRenamed("k", key)


def fold_lines(text: str, budget: int) -> list[tuple[int, int, int, str]]:
    out: list[tuple[int, int, int, str]] = []
    held: list[str] = []
    size = 0
    for n, line in enumerate(text.split("\n"), 1):
        more = len(line) + 1
        if held and size + more > budget:
            out.append((len(out), n - len(held), n - 1, "\n".join(held)))
            held, size = [], 0
        held.append(line)
        size += more
    n = text.count("\n") + 1
    out.append((len(out), n - len(held) + 1, n, "\n".join(held)))
    return out


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each heading with its depth and the lines up to the next heading of the same depth or less."""
    found = lines(docs, key, text)
    last = found.groupBy(key).agg(F.max("line_no").alias("_last"))
    heads = found.select(key, "line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("depth"), F.regexp_extract("line", HEADING, 2).alias("title")).filter("depth > 0")
    later = W.partitionBy(key).orderBy("line_no").rowsBetween(1, W.unboundedFollowing)
    ends = [F.min(F.when(F.col("depth") <= d, F.col("line_no"))).over(later) for d in range(1, 7)]
    end = F.element_at(F.array(*ends), F.col("depth"))
    return heads.withColumn("_end", end).join(last, key).select(key, "title", "depth", F.col("line_no").alias("first_line"), F.coalesce(F.col("_end") - 1, "_last").alias("last_line"))


def window_of(text: Column, offset: int, most: int) -> tuple[Column, Column]:
    """A piece of a text from a character offset, and where the next one starts (null at the end)."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.substring(F.coalesce(text, F.lit("")), offset + 1, most), F.when(n > offset + most, F.lit(offset + most))


def line_range(text: Column, first: int, last: int | None = None) -> Column:
    """Lines first to last (from 1, both included; last defaults to first)."""
    end = first if last is None else last
    return F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), first, max(0, end - first + 1)), "\n")


def clamp(first: Column, last: Column, total: Column) -> tuple[Column, Column]:
    """A page or slide window inside 1..total; a missing end is the start."""
    low = F.least(F.greatest(first, F.lit(1)), total)
    return low, F.least(F.greatest(F.coalesce(last, low), low), total)


def citations(answers: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, marker, entry_id, quote, page, section_id, reason of each footnote `[^n]: entry_id=..., quote="...", page=...`."""
    notes = answers.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^\[\^([^\]]+)\]:\s*(.*entry_id\s*=.*)$"), F.lit(0))).alias("note"))

    def field(name: str) -> Column:
        quoted = F.regexp_extract("note", rf'(?i)\b{name}\s*=\s*"((?:[^"\\]|\\.)*)"', 1)
        plain = F.regexp_extract("note", rf"(?i)\b{name}\s*=\s*([^,;|\s\"]+)", 1)
        value = F.when(quoted != "", F.regexp_replace(quoted, r'\\(["\\])', "$1")).otherwise(plain)
        return F.when(F.trim(value) != "", F.trim(value))

    trailer = F.nullif(F.trim(F.regexp_extract("note", r"\|\s*([^|]*)$", 1)), F.lit(""))
    return notes.select(
        key, F.regexp_extract("note", r"^\[\^([^\]]+)\]", 1).alias("marker"), field("entry_id").alias("entry_id"), field("quote").alias("quote"),
        F.coalesce(field("page"), field("slide")).alias("page"), field("section_id").alias("section_id"), F.coalesce(trailer, field("reason")).alias("reason"),
    ).filter("entry_id IS NOT NULL")


class _Plain(dict):
    """What becomes of each character: nothing of blanks, marks and control characters, else its case-folded form."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kept = self[code] = "" if c.isspace() or unicodedata.category(c)[0] in "PZC" else c.casefold()
        return kept


_PLAIN = _Plain()


def plain_quote(text: str) -> str:
    """Compatibility form without blanks, punctuation and control characters, case-folded."""
    return unicodedata.normalize("NFKC", text).translate(_PLAIN)


@F.arrow_udf(StringType())
def plain(text: pa.Array) -> pa.Array:
    """`plain_quote` of a column, once for each text; null stays null. One text at a time is an object."""
    return pa.array((t if (t := x.as_py()) is None else plain_quote(t) for x in text), pa.string())


@F.arrow_udf(BooleanType())
def quote_in(source: pa.Array, quote: pa.Array) -> pa.Array:
    """True where the quote's characters stand in the source in order; an empty quote is nowhere. One text at a time is an object."""

    def found(source: str | None, quote: str | None) -> bool:
        needle = plain_quote(quote or "")
        # a text that holds the quote as it stands needs no plain form
        return bool(needle) and (quote in (source or "") or needle in plain_quote(source or ""))

    return pa.array((found(s.as_py(), q.as_py()) for s, q in zip(source, quote)), pa.bool_())


def first_page(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """quote_id and the first page (doc_id, page, text) that holds the quote (quote_id, doc_id, quote)."""
    met = quotes.join(pages, "doc_id").filter(quote_in("text", "quote"))
    return quotes.select("quote_id").join(met.groupBy("quote_id").agg(F.min("page").alias("page")), "quote_id", "left")


def mails(rows: DataFrame, content: str = "content") -> DataFrame:
    """Subject, sender, receiver, date, body (plain part first, else HTML) and attachment names of raw mails."""
    kept = [c for c in rows.columns if c != content]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes if n != content), "subject string, sender string, receiver string, sent string, body string, is_html boolean, attachments array<string>"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_mail(c) for c in batch[content]]
            made = pd.DataFrame(out, columns=["subject", "sender", "receiver", "sent", "body", "is_html", "attachments"], index=batch.index)
            yield pd.concat([batch[kept], made], axis=1)

    return rows.mapInPandas(read, schema)


def _mail(content: bytes | None) -> tuple:
    m = email.message_from_bytes(content or b"", policy=email.policy.default)
    part = m.get_body(preferencelist=("plain", "html"))
    body = part.get_content() if part is not None and part.get_content_maintype() == "text" else ""
    names = [a.get_filename() or "unnamed" for a in m.iter_attachments()] if m.is_multipart() else []
    head = [str(m[h]) if m[h] is not None else None for h in ("subject", "from", "to", "date")]
    return (*head, body, bool(part is not None and part.get_content_subtype() == "html"), names)


def delimiter(text: Column) -> Column:
    """The mark of tab, bar, semicolon and comma that splits the first lines alike and most often; null if none does."""
    head = F.filter(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 20), lambda x: F.trim(x) != "")
    def choice(mark: str) -> Column:
        counts = F.transform(head, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))
        even = (F.size(counts) > 1) & (F.array_min(counts) == F.array_max(counts)) & (F.array_min(counts) > 0)
        return F.when(even, F.struct(F.array_min(counts).alias("n"), F.lit(mark).alias("mark")))

    choices = [choice(mark) for mark in ("\t", "|", ";", ",")]
    return F.array_max(F.array_compact(F.array(*choices)))["mark"]


def matches_glob(path: Column, pattern: str) -> Column:
    """Shell pattern over a whole path; `*` and `**` also pass folders."""
    return path.rlike(shell_regex(pattern))


def listable(path: Column) -> Column:
    """False for absolute paths, paths that go up, and system or build folders."""
    return ~path.rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)|(^|/)(\.git|__pycache__|node_modules|__MACOSX|\.DS_Store)(/|$)|\.(pyc|class|o)$")


def directory_lines(paths: DataFrame, depth: int = 4) -> DataFrame:
    """path, depth, name and files below of every folder and file up to `depth` levels, in listing order by path."""
    parts = F.split("path", "/")
    step = F.explode(F.sequence(F.lit(1), F.least(F.size("_p"), F.lit(depth)))).alias("depth")
    rows = paths.select("path", parts.alias("_p")).select("path", "_p", step)
    rows = rows.select(F.array_join(F.slice("_p", F.lit(1), F.col("depth")), "/").alias("path"), "depth", F.element_at("_p", F.col("depth")).alias("name"))
    return rows.groupBy("path", "depth", "name").agg(F.count(F.lit(1)).alias("files"))


#: Labels of an answer, and the words that stand for each where none is stated, in order.
VERDICT_WORDS = (
    ("INSUFFICIENT", ("insufficient", "cannot be verified", "not possible to")),
    ("CONTRADICT", ("contradict", "incorrect", "does not support")),
    ("SUPPORT", ("support", "accurate", "consistent with")),
)


def verdict(text: Column) -> Column:
    """Label of an answer: the one that a line states, else by the words it uses, else null."""
    text = F.coalesce(text, F.lit(""))
    stated = F.upper(F.regexp_extract(text, r"(?im)^\s*(?:\*\*)?\s*verdict\s*:\s*(support|contradict|insufficient)\b", 1))
    low, label = F.lower(text), F.when(stated != "", stated)
    for name, words in VERDICT_WORDS:
        said = F.lit(False)
        for w in words:
            said = said | F.contains(low, F.lit(w))
        label = label.when(said, name)
    return label


def sections_digest(rows: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """Lines of titles in order, as many as fit in `budget` characters. `rows` has key, position and title."""
    w = W.partitionBy(key).orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    kept = rows.withColumn("_n", F.sum(F.length("title") + 3).over(w)).filter(F.col("_n") <= budget)
    steps = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "title"))).alias("_t"))
    return steps.select(key, F.array_join(F.transform("_t", lambda t: F.concat(F.lit("- "), t["title"])), "\n").alias("digest"))


def chart(rows: DataFrame, x: str, y: str, aggregate: str = "count", limit: int = 1000) -> DataFrame:
    """x and the aggregate of y, at most `limit` groups, in order of x: the data behind a chart."""
    known = {"count": F.count, "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "stdev": F.stddev_samp}
    if aggregate not in known:
        raise ValueError(f"unknown aggregate {aggregate}")
    return rows.groupBy(x).agg(known[aggregate](y).alias(aggregate)).orderBy(x).limit(limit)
