"""What answers rest on: patterns of a query, tag seeds, page labels, reads of documents, quoted evidence, checkpoints."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quern.functions.text import FACET_WEIGHTS, RANK_STOP_WORDS, plain_summary
from quern.operators.documents import chunks, plain
from quern.operators.members import split_lines
from quern.plans.lineage import cut
from quern.plans.ordered import running

#: Words that mark a sentence as a constraint, a decision or a next step.
CONSTRAINT_TERMS = ("must", "never", "required", "cannot", "必须", "不要", "不能", "要求")
DECISION_TERMS = ("decision", "decided", "recommend", "conclusion", "决定", "结论", "建议")
NEXT_TERMS = ("next", "todo", "remaining", "下一步", "待办", "尚未")
#: Stop words of query patterns, and how many patterns a query gives.
PATTERN_STOP_WORDS = tuple(sorted({*RANK_STOP_WORDS, "against"}))
MAX_PATTERNS = 8
#: What a member of an archive ranks by, smaller first; names that rank two higher; how many are read.
MEMBER_PRIORITY = {
    ".md": 0, ".rst": 0, ".txt": 1, ".pdf": 1, ".docx": 1, ".pptx": 1, ".pptm": 1, ".xlsx": 2, ".xls": 2, ".epub": 2, ".eml": 2, ".msg": 2, ".log": 2,
    ".py": 3, ".js": 3, ".ts": 3, ".go": 3, ".rs": 3, ".java": 3, ".json": 4, ".yaml": 4, ".yml": 4, ".toml": 4, ".html": 5, ".csv": 5,
}
MEMBER_NAMES = ("readme", "license", "changelog", "pyproject", "package.json", "cargo.toml", "go.mod")
MEMBERS, TINY_MEMBERS, TINY_BYTES = 8, 16, 4096
#: Lines of a log that are indexed, and bytes of it that are read.
LOG_LINES, LOG_BYTES = 400, 50 << 20


def _first_of_each(items: Column, key) -> Column:
    """Items without those whose key an earlier one has."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def query_patterns(query: Column, most: int = MAX_PATTERNS) -> Column:
    """Patterns to look for in a document: a query's words, escaped, without stop words, repeats and short noise."""
    words = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9+_./,-]*"), F.lit(0))
    words = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
    short = lambda w: (F.length(w) < 4) & ~w.rlike("[0-9A-Z]")
    kept = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*PATTERN_STOP_WORDS) & ~short(w))
    return F.transform(F.slice(_first_of_each(kept, F.lower), 1, most), lambda w: F.regexp_replace(w, r"([+.-])", r"\\$1"))


def generic_title(title: Column) -> Column:
    """True for titles that say nothing: the whole document, or a number of lines, pages or sections."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))
    return low.rlike(r"^(document|full document|entire document|lines \d+-\d+|page \d+|section \d+|ocr page \d+)$")


def tag_seed(value: Column) -> Column:
    """A struct of name and facet: `facet:name` is parted where the facet is a known one, else the facet is null."""
    facet, name = F.substring_index(value, ":", 1), F.trim(F.regexp_extract(value, r"(?s)^[^:]*:(.*)$", 1))
    known = facet.isin(*FACET_WEIGHTS) & (name != "")
    return F.struct(F.when(known, name).otherwise(value).alias("name"), F.when(known, facet).alias("facet"))


def resolve_labels(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """ask_id and page: the only page of the document with the label asked for, else the page of that number, else null.

    `pages` has doc_id, page (from 1) and label; `asked` has ask_id, doc_id and value: a number, which must be positive, or a
    text, whose first number counts.
    """
    label = F.lower(F.trim(F.col("label")))
    named = pages.groupBy("doc_id", label.alias("_l")).agg(F.count(F.lit(1)).alias("_n"), F.min("page").alias("_page")).filter("_n = 1").select("doc_id", "_l", "_page")
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_total"))
    is_text = dict(asked.dtypes)["value"] == "string"
    number = F.regexp_extract("value", r"\d+", 0).try_cast("long") if is_text else F.col("value").cast("long")
    rows = asked.withColumn("_number", F.when(number > 0, number)).withColumn("_l", F.col("_number").cast("string"))
    rows = rows.join(named, ["doc_id", "_l"], "left").join(total, "doc_id", "left")
    ordinal = F.when(F.col("_number") <= F.col("_total"), F.col("_number"))
    return rows.select("ask_id", F.coalesce("_page", ordinal).cast("long").alias("page"))


def expand_patterns(requests: DataFrame) -> DataFrame:
    """A request for each of its patterns (`pattern`, then `patterns`), each once; requests without any stay as they are."""
    listed = F.concat(F.array_compact(F.array(F.nullif("pattern", F.lit("")))), F.filter(F.coalesce("patterns", F.array().cast("array<string>")), lambda p: p != ""))
    # a place tells equal patterns apart from the order they came in
    wanted = F.when(F.size(listed) == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(listed))
    kept = [c for c in requests.columns if c not in ("pattern", "patterns")]
    return requests.select(*kept, F.posexplode(wanted).alias("read", "pattern"))


#: Lines that say which page or slide the text behind them is of.
PAGE_MARK = r"^(?:\[(?:OCR )?Page (\d+)\]|#{1,3} (?:OCR )?Page (\d+)|# Slide (\d+)(?::[^\n]*)?)\s*$"


def page_spans(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, page (null before the first mark) and span: a text parted at the lines that mark pages and slides."""
    cut = F.split(F.col(text), rf"(?m)(?={PAGE_MARK})")
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.explode(cut).alias("_span"))
    mark = rf"(?m)\A{PAGE_MARK}"
    number = F.coalesce(*[F.nullif(F.regexp_extract("_span", mark, i), F.lit("")) for i in (1, 2, 3)]).cast("long")
    return rows.select(key, number.alias("page"), F.regexp_replace("_span", mark, "").alias("span"))


def quoted_evidence(citations: DataFrame, reads: DataFrame) -> DataFrame:
    """cite_id, supported, page_supported and page of each citation: is its quote in a read of the same turn and entry, and where.

    `citations` has cite_id, turn, entry_id, quote and page (null: none is claimed); `reads` has turn, entry_id, page_start,
    page_end, slide_start, slide_end and text. Where marks in the text part it by pages, the parts that hold the quote tell
    the page; else a read of one page or slide tells it, and one of several tells none. A claimed page must be one of
    those; without a claim the page is told if it is the only one. A quote without letters or digits is nowhere.
    """
    read = reads.filter("trim(text) <> ''").withColumn("_read", F.monotonically_increasing_id())
    read = cut(read.select("_read", "turn", "entry_id", "page_start", "page_end", "slide_start", "slide_end", "text"))
    asked = citations.select("cite_id", "turn", "entry_id", "page", plain("quote").alias("_quote")).filter("_quote <> ''")
    one = lambda a, b: F.when((F.col(a) > 0) & (F.col(a) == F.coalesce(b, a)), F.col(a))
    whole_range = (F.col("page_start") > 0) & (F.coalesce("page_end", "page_start") >= F.col("page_start"))
    named = F.when(whole_range, one("page_start", "page_end")).otherwise(one("slide_start", "slide_end")).cast("long")
    whole = read.select("_read", "turn", "entry_id", named.alias("_named"), plain("text").alias("_whole"))
    met = asked.join(whole, ["turn", "entry_id"]).filter(F.contains("_whole", "_quote")).select("cite_id", "_quote", "_read", "_named")
    spans = page_spans(read, "_read").filter("page IS NOT NULL").select("_read", F.col("page").alias("_marked"), plain("span").alias("_span"))
    marked = met.join(spans, "_read").filter(F.contains("_span", "_quote")).groupBy("cite_id", "_read").agg(F.collect_set("_marked").alias("_marked"))
    pages = met.join(marked, ["cite_id", "_read"], "left").select("cite_id", F.coalesce("_marked", F.array_compact(F.array("_named"))).alias("_pages"))
    found = pages.groupBy("cite_id").agg(F.array_distinct(F.flatten(F.collect_set("_pages"))).alias("_pages"))
    rows = citations.select("cite_id", F.col("page").cast("long").alias("_claimed")).join(found, "cite_id", "left")
    supported = F.col("_pages").isNotNull()
    right = F.array_contains("_pages", F.col("_claimed"))
    only = F.when(F.size("_pages") == 1, F.element_at("_pages", 1))
    return rows.select("cite_id", supported.alias("supported"), F.coalesce(right | ~supported, F.lit(True)).alias("page_supported"), F.when(F.col("_claimed").isNull(), only).when(right, F.col("_claimed")).alias("page"))


def _sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[.!?。！？；])\s*", "\n"), r"\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _bounded(text: Column, most: int) -> Column:
    text = F.trim(text)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…")))


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    low, found = F.lower(text), F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return found


#: The lists of a checkpoint as it is written, and the order in which they give way, oldest item first.
CHECKPOINT = {"version": 1, "goal": [], "constraints": [], "progress": [], "key_decisions": [], "next_steps": [], "critical_context": [], "evidence_entry_ids": [], "evidence": [], "scopes": [], "tool_history": []}
DROP_ORDER = ("tool_history", "progress", "goal", "key_decisions", "constraints", "next_steps", "scopes", "evidence", "evidence_entry_ids")
#: Lists that keep an item while anything else can go; a checkpoint's least budget; what critical context holds.
KEPT_LISTS, LEAST_BUDGET, CRITICAL_ITEMS, CRITICAL_CHARS = ("goal", "progress"), 256, 20, 800
#: What places a passage, what a call was limited to, and evidence of one call at most.
LOCATORS = ("entry_id", "quote", "page", "page_start", "page_end", "line_start", "line_end", "paragraph_start", "paragraph_end", "section_id", "heading", "member_path", "sha256", "content_sha256", "file_sha256", "version")
SCOPES, CALL_EVIDENCE = ("view_id", "catalog_id", "folder_id"), 100
ENTRY_ID = r"entry_id=([0-9a-fA-F-]{8,})"


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def _shortened(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most].rstrip() + "…"


def call_items(turn: int, name: str | None, given: str | None, got: str | None, error: str | None) -> list[tuple[str, str]]:
    """What a tool call adds to a checkpoint: (list, JSON of the item), in order. `given` and `got` are JSON, else plain text."""

    def parsed(text):
        try:
            return json.loads(text) if text else None
        except ValueError:
            return text

    def preview(value, most):
        written = _json(value)
        return value if value is None or len(written) <= most else {"preview": written[:most].rstrip() + "…", "truncated": True}

    given, got = parsed(given) or None, parsed(got) or None
    item = {"turn": turn, "name": name or "tool", "input": preview(given, 1000), "result": preview(got, 1500), "error": _shortened((error or "").strip(), 500) or None}
    items = [("tool_history", _json(item))]
    items += [("evidence_entry_ids", _json(i)) for i in re.findall(ENTRY_ID, _json(item))]
    found: dict[str, None] = {}
    held = [got]
    while held:
        value = held.pop()
        if isinstance(value, dict):
            if value.get("entry_id"):
                found[_json({k: value[k] for k in LOCATORS if k in value and value[k] not in (None, "")})] = None
            held += reversed(value.values())
        elif isinstance(value, list):
            held += reversed(value)
    items += [("evidence", e) for e in list(found)[:CALL_EVIDENCE]]
    scope = {k: given[k] for k in SCOPES if given.get(k) not in (None, "", [])} if isinstance(given, dict) else {}
    return items + ([("scopes", _json(scope))] if scope else [])


def _critical(lists: dict[str, list[str]]) -> list[str]:
    """JSON of what matters most of the other lists: rules, decisions, steps, then where evidence is; the last of them."""
    said = dict.fromkeys(_shortened(json.loads(x).strip(), CRITICAL_CHARS) for kind in ("constraints", "key_decisions", "next_steps") for x in lists.get(kind, ()))
    ids = [json.loads(x) for x in lists.get("evidence_entry_ids", ())]
    where = ["Evidence entry IDs: " + ", ".join(ids)] if ids else []
    where += ["Evidence locator: " + e for e in lists.get("evidence", ())]
    return [_json(x) for x in [*said, *where][-CRITICAL_ITEMS:]]


def fit(lists: dict[str, list[str]], budget: int) -> dict[str, list[str]]:
    """The lists (JSON of items, oldest first) without what has to go before all of them, written as JSON, take `budget` bytes."""
    lists = {k: list(v) for k, v in lists.items()}
    bytes_of = lambda items: sum(len(x.encode()) + 2 for x in items) - (2 if items else 0)
    size = len(_json(CHECKPOINT)) + sum(bytes_of(v) for v in lists.values())
    going = [(kind, n) for kind in DROP_ORDER for n in range(len(lists.get(kind, ())) - (kind in KEPT_LISTS))]
    going += [(kind, 0) for kind in DROP_ORDER if kind in KEPT_LISTS and lists.get(kind)]
    critical = _critical(lists)
    for kind, _ in going:
        if size + bytes_of(critical) <= budget:
            break
        size += bytes_of(lists[kind][1:]) - bytes_of(lists[kind])
        del lists[kind][0]
        if kind not in ("tool_history", "progress", "goal", "scopes"):
            critical = _critical(lists)
    return lists | {"critical_context": critical}


def checkpoint_items(turns: DataFrame, budget: int, calls: DataFrame | None = None) -> DataFrame:
    """conv_id, kind, place and item (JSON): the checkpoint of each conversation that takes `budget` bytes of JSON at most.

    `turns` has conv_id, turn, role and text: users' texts are goals and hold constraints, others' are progress and hold
    decisions, next steps and entry ids. `calls` has conv_id, turn, position, name, input, output (JSON) and error, the tool
    calls. An item that a conversation repeats is kept where it first came. Items give way list by list, oldest first, until the
    rest fits; a goal and a progress stay while anything else can go. Since what stays takes no more than the budget, older
    items of a list than that are left out by running totals, so what a task holds of a conversation is a few budgets.
    """
    budget = max(LEAST_BUDGET, budget)
    user, text = F.col("role") == "user", F.coalesce("text", F.lit(""))
    whole = lambda kind, size: F.array(F.struct(F.lit(kind).alias("kind"), _bounded(text, size).alias("s")))

    def picked(kind: str, words: tuple[str, ...], size: int) -> Column:
        return F.transform(F.filter(F.col("_s"), lambda s: _mentions(s, words)), lambda s: F.struct(F.lit(kind).alias("kind"), _bounded(s, size).alias("s")))

    ids = F.transform(F.regexp_extract_all(text, F.lit(ENTRY_ID), F.lit(1)), lambda i: F.struct(F.lit("evidence_entry_ids").alias("kind"), i.alias("s")))
    said = F.when(user, F.concat(whole("goal", 2000), picked("constraints", CONSTRAINT_TERMS, 800))).otherwise(
        F.concat(whole("progress", 2500), picked("key_decisions", DECISION_TERMS, 1000), picked("next_steps", NEXT_TERMS, 1000), ids)
    )
    rows = turns.withColumn("_s", _sentences(F.col("text"))).select("conv_id", "turn", F.lit(-1).alias("_call"), F.posexplode(said).alias("_at", "_i"))
    rows = rows.filter("_i.s <> ''").select("conv_id", "turn", "_call", "_at", F.col("_i.kind").alias("kind"), _as_json("_i.s").alias("item"))
    if calls is not None:
        made = F.explode(_call_items("turn", "name", "input", "output", "error")).alias("_i")
        used = calls.select("conv_id", "turn", F.col("position").alias("_call"), made)
        rows = rows.unionByName(used.select("conv_id", "turn", F.col("_call").cast("int").alias("_call"), F.col("_i.at").alias("_at"), F.col("_i.kind").alias("kind"), F.col("_i.item").alias("item")))
    first = rows.groupBy("conv_id", "kind", "item").agg(F.min(F.struct("turn", "_call", "_at")).alias("_f"))
    newest = first.select("conv_id", "kind", "item", *[(-F.col(f"_f.{c}")).alias(f"_{i}") for i, c in enumerate(("turn", "_call", "_at"))], F.octet_length("item").alias("_size"))
    near = running(newest, ["conv_id", "kind"], ["_0", "_1", "_2", "item"], {"_total": F.col("_size")}, count="_n").filter((F.col("_total") <= budget) | (F.col("_n") == 1))
    kind = dict(turns.dtypes)["conv_id"]

    def keep(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("_n", ascending=False)
        lists = fit({k: list(g["item"]) for k, g in items.groupby("kind", sort=False)}, budget)
        out = [(items["conv_id"].iloc[0], k, n, x) for k, v in lists.items() for n, x in enumerate(v, 1)]
        return pd.DataFrame(out, columns=["conv_id", "kind", "place", "item"])

    return near.select("conv_id", "kind", "item", "_n").groupBy("conv_id").applyInPandas(keep, f"conv_id {kind}, kind string, place int, item string")


@F.pandas_udf(StringType())
def _as_json(text: pd.Series) -> pd.Series:
    return text.map(_json)


@F.pandas_udf(ArrayType(StructType([StructField("at", IntegerType()), StructField("kind", StringType()), StructField("item", StringType())])))
def _call_items(turn: pd.Series, name: pd.Series, given: pd.Series, got: pd.Series, error: pd.Series) -> pd.Series:
    rows = zip(turn.tolist(), name, given, got, error)
    return pd.Series([[{"at": n, "kind": k, "item": x} for n, (k, x) in enumerate(call_items(*r))] for r in rows])


def _order(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def log_coverage(lines: DataFrame, total_bytes: DataFrame, most_lines: int = LOG_LINES, most_bytes: int = LOG_BYTES) -> DataFrame:
    """A row for each log with what of it is indexed: the first lines, of the first bytes.

    `lines` has path, line_no and text, `total_bytes` has path and total_bytes. Reasons for a part are byte_cap and log_sample.
    """
    counted = lines.groupBy("path").agg(F.count(F.lit(1)).alias("total_lines"), F.count_if(F.col("line_no") <= most_lines).alias("indexed_lines"))
    rows = counted.join(total_bytes, "path").withColumn("indexed_bytes", F.least("total_bytes", F.lit(most_bytes)))
    reasons = F.array_compact(F.array(F.when(F.col("indexed_bytes") < F.col("total_bytes"), F.lit("byte_cap")), F.when(F.col("indexed_lines") < F.col("total_lines"), F.lit("log_sample"))))
    return rows.select("path", "total_lines", "indexed_lines", "total_bytes", "indexed_bytes", reasons.alias("partial_reasons")).withColumn("indexed_partial", F.size("partial_reasons") > 0)


def indexed_lines(lines: DataFrame, most_lines: int = LOG_LINES) -> DataFrame:
    """path, line_no and view: the lines of a log that are indexed, each with its number."""
    return lines.filter(F.col("line_no") <= most_lines).select("path", "line_no", F.concat(F.lit("L"), "line_no", F.lit(": "), "text").alias("view"))


#: Words that name a topic where no model reads a text, and what a search result tells of coverage.
PLAIN_TOPICS = ("release", "rollback", "security", "support", "deploy", "incident")
COVERAGE_KEYS = (
    "unit", "total_pages", "indexed_pages", "total_units", "indexed_units", "total_bytes", "indexed_bytes", "total_chars", "indexed_chars", "total_lines", "indexed_lines", "total_rows", "indexed_rows",
    "indexed_partial", "partial_reasons", "source_mode", "max_index_pages", "max_index_bytes", "max_index_chars", "max_rows_per_sheet", "max_sample_lines", "sampled", "chunked", "chunk_count",
    "text_truncated", "truncated_chunks", "ocr_used", "ocr_pages_done",
)


def compact_coverage(description: Column) -> Column:
    """The known keys of a JSON description's coverage as JSON, values as they are; null where there are none, or no object."""
    found = F.try_parse_json(description)
    value = lambda k: F.to_json(F.try_variant_get(found, f"$.coverage.{k}", "variant"))
    parts = F.array_compact(F.array(*[F.concat(F.lit(f'"{k}":'), value(k)) for k in COVERAGE_KEYS]))
    return F.when(F.size(parts) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def plain_index(docs: DataFrame, single: int = 12_000, chunk: int = 50_000) -> DataFrame:
    """What is indexed of a document where no model reads it: doc_id, summary, tags, anchor, chunk_count and chunked.

    `docs` has doc_id, text (null: empty), kind, and the strings name, mime and ext (null: none). Topics are looked for in these and
    the text's first 4000 characters; the kind is the form, else `document`; equal tags stand once. The one section is the
    whole document, at lines 1 to the last. Only texts of over `single` characters are chunked.
    """
    text = F.coalesce("text", F.lit(""))
    source = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "mime", "ext", "kind")], F.nullif(F.substring(text, 1, 4000), F.lit(""))))
    tag = lambda facet, name: F.struct(F.lit(facet).alias("facet"), name.alias("name"))
    kind = F.nullif(F.coalesce("kind", F.lit("")), F.lit(""))
    topics = F.array_compact(F.array(*[F.when(F.contains(source, F.lit(w)), tag("topic", F.lit(w))) for w in PLAIN_TOPICS]))
    forms = F.when(kind.isNotNull(), F.array(tag("form", kind))).otherwise(F.when(F.size(topics) == 0, F.array(tag("form", F.lit("document")))).otherwise(F.slice(F.array(tag("form", F.lit(""))), 1, 0)))
    long = docs.filter(F.length("text") > single)
    counts = chunks(long.select("doc_id", F.array_join(split_lines(F.col("text")), "\n").alias("text")), chunk).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    summary = plain_summary(F.col("text"))
    rows = docs.join(counts.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    count = F.coalesce("_n", F.lit(1)).cast("int")
    return rows.select(
        "doc_id", F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(F.concat(F.lit("No "), F.coalesce("kind", F.lit("")), F.lit(" content extracted."))).alias("summary"),
        F.concat(topics, forms).alias("tags"), F.concat(F.lit("1-"), F.greatest(F.size(split_lines(text)), F.lit(1))).alias("anchor"), count.alias("chunk_count"), (count > 1).alias("chunked"),
    )


def normal_sections(sections: DataFrame, unit: str = "lines", most: int = 200) -> DataFrame:
    """The first sections of each document with defaults: a title by number, an id s1, s2, ..., an anchor at the title.

    `sections` has doc_id, position (from 1), id, title, summary, key_terms (array) and anchor; at most 20 terms stay.
    """
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    title = F.coalesce(clean("title"), F.concat(F.lit("Section "), "position"))
    terms = F.slice(F.filter(F.transform(F.coalesce("key_terms", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != ""), 1, 20)
    rows = sections.filter(F.col("position") <= most)
    return rows.select(
        "doc_id", "position", F.coalesce(clean("id"), F.concat(F.lit("s"), "position")).alias("id"), title.alias("title"), F.coalesce(clean("summary"), F.lit("")).alias("summary"),
        terms.alias("key_terms"), F.struct(F.lit(unit).alias("unit"), F.coalesce(clean("anchor"), title).alias("value")).alias("anchor"),
    )


def retrieval_extra(sections: DataFrame, coverage: DataFrame, most_terms: int = 160, most_sections: int = 80) -> DataFrame:
    """doc_id and extra: coverage, terms and the map of sections of a document as lines to search in.

    `sections` is normal; `coverage` has doc_id, unit, total_units, indexed_units, indexed_partial and chunk_count. At most
    200 sections a document come from `normal_sections`, so a document's are one row here.
    """
    step = F.struct("position", "id", "title", "summary", "key_terms", F.col("anchor.value").alias("anchor"))
    rows = coverage.join(sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(step)).alias("_s")), "doc_id", "left")
    s = F.coalesce("_s", F.array().cast(sections.select(F.array(step).alias("x")).schema["x"].dataType))
    terms = F.filter(F.flatten(F.transform(s, lambda x: F.concat(x["key_terms"], F.array(x["title"])))), lambda t: t != "")
    listed = F.array_join(F.slice(_first_of_each(terms, F.lower), 1, most_terms), "; ")
    bits = F.transform(F.slice(s, 1, most_sections), lambda x: F.substring(F.array_join(F.filter(F.array(x["id"], x["anchor"], x["title"], x["summary"]), lambda p: p != ""), " "), 1, 220))
    more = F.when(F.size(s) > most_sections, F.concat(F.lit(" | ... "), F.size(s) - most_sections, F.lit(" more sections"))).otherwise("")
    covered = F.concat(F.lit("indexed_coverage: "), "indexed_units", F.lit("/"), "total_units", F.lit(" "), "unit", F.lit("; partial="), F.col("indexed_partial").cast("string"), F.lit("; chunk_count="), "chunk_count")
    lines = F.array(covered, F.when(listed != "", F.concat(F.lit("retrieval_terms: "), listed)), F.when(F.size(s) > 0, F.concat(F.lit("section_map: "), F.array_join(bits, " | "), more)))
    return rows.select("doc_id", F.array_join(F.array_compact(lines), "\n").alias("extra"))


def ranked_members(members: DataFrame) -> DataFrame:
    """archive, member, size and place of the members worth a look: by kind and name, then size; more where all are small."""
    name = F.lower(F.substring_index("member", "/", -1))
    suffix = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    table = F.create_map(*[F.lit(x) for kv in MEMBER_PRIORITY.items() for x in kv])
    known = F.lit(False)
    for n in MEMBER_NAMES:
        known = known | F.contains(name, F.lit(n))
    rank = F.coalesce(table[suffix], F.lit(9)) - F.when(known, 2).otherwise(0)
    place = F.row_number().over(_order("archive").orderBy(rank, "size", "member"))
    rows = members.select("archive", "member", "size", place.alias("place"), F.max("size").over(_order("archive")).alias("_most"))
    return rows.filter(F.col("place") <= F.when(F.col("_most") < TINY_BYTES, TINY_MEMBERS).otherwise(MEMBERS)).drop("_most")


def semantic_inputs(entries: DataFrame, files: DataFrame, sections: DataFrame, active: tuple[str, ...], most: int = 200, size: int = 6000) -> DataFrame:
    """record_id, entry_id, section_id (null: the entry itself) and text: what is embedded of live, active, indexed entries.

    `sections` is normal and by file_id; sections with generic titles are left out, and of the others the first `most` stay.
    """
    live = entries.filter(F.col("deleted_at").isNull() & F.col("lifecycle").isin(*active)).select("entry_id", "file_id", "display_name")
    done = files.filter(F.col("deleted_at").isNull() & (F.col("ingest_status") == "done")).select("file_id", "summary")
    rows = live.join(done, "file_id")
    whole = F.array_join(F.filter(F.array(F.trim("display_name"), F.trim(F.coalesce("summary", F.lit("")))), lambda p: p != ""), "\n")
    entry = rows.select(F.col("entry_id").cast("string").alias("record_id"), "entry_id", F.lit(None).cast("string").alias("section_id"), F.substring(whole, 1, size).alias("text"))
    stable = sections.filter(~generic_title(F.col("title"))).withColumn("_n", F.row_number().over(_order("file_id").orderBy("position"))).filter(F.col("_n") <= most)
    line = F.array_join(F.filter(F.array("title", "summary", F.array_join("key_terms", " ")), lambda p: p != ""), " ")
    text = F.concat(F.when(F.coalesce(F.col("_summary"), F.lit("")) != "", F.concat(F.lit("summary: "), "_summary", F.lit("\n\n"))).otherwise(""), F.lit("section: "), line)
    part = rows.withColumnRenamed("summary", "_summary").join(stable, "file_id")
    part = part.select(F.concat(F.col("entry_id").cast("string"), F.lit("#section:"), "id").alias("record_id"), "entry_id", F.col("id").alias("section_id"), F.substring(text, 1, size).alias("text"))
    return entry.union(part).filter("text <> ''")


def same_index(manifest: DataFrame, version: int, provider: str, model: str, dimensions: int) -> DataFrame:
    """Rows of a manifest table that an index of these settings may be searched with; a provider not recorded counts as any."""
    provided = F.col("provider").isNull() | (F.col("provider") == provider)
    return manifest.filter((F.col("version") == version) & provided & (F.col("model") == model) & (F.col("dimensions") == dimensions))
