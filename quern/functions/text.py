"""Text expressions: hits, term weights, digests, normalised queries. All are Columns; nothing runs in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search leaves out, and further ones that ranking leaves out.
STOP_WORDS = ("about", "after", "against", "and", "are", "does", "from", "have", "into", "than", "that", "the", "their", "this", "with")
RANK_STOP_WORDS = ("about", "after", "and", "are", "consisting", "does", "from", "have", "into", "larger", "than", "that", "the", "their", "this", "with")
#: What a tag of a facet weighs in ranking; 2 for any other facet.
FACET_WEIGHTS = {"topic": 8.0, "source": 5.0, "time": 4.0, "extra": 4.0, "form": 1.5, "language": 0.5}
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_CJK = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_SPLIT = re.compile(r'"([^"]*)"|[^\s,，、;；]+')


def query_terms(query: str) -> list[str]:
    """Terms of a query string: quoted phrases stay whole, case-folded repeats go, order stays."""
    terms: dict[str, str] = {}
    for m in _SPLIT.finditer(query):
        t = (m.group(1) if m.group(1) is not None else m.group(0)).strip()
        if t:
            terms.setdefault(t.casefold(), t)
    return list(terms.values())


def search_terms(query: str) -> list[str]:
    """Terms that select rows: stop words go."""
    return [t for t in query_terms(query) if t.lower() not in STOP_WORDS]


def rank_terms(terms: list[str]) -> list[str]:
    """Terms that score rows: each term whole, then its words; bare of marks, without stop words, repeats and short noise."""
    found: dict[str, str] = {}
    for term in terms:
        for t in (term, *re.findall(r"[A-Za-z0-9][A-Za-z0-9+_./-]*", term)):
            t = t.strip().strip(".,;:!?()[]{}\"'")
            noise = len(t) < 4 and not any(c.isdigit() or c.isupper() for c in t) and not _CJK.search(t)
            if t and not noise and t.casefold() not in RANK_STOP_WORDS:
                found.setdefault(t.casefold(), t)
    return list(found.values())


def facet_weight(facet: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FACET_WEIGHTS.items() for x in kv])
    return F.coalesce(table[facet], F.lit(2.0))


def hits(haystack: Column, term: str) -> Column:
    """Times that `term` occurs, without overlap and regardless of case."""
    low = F.lower(F.coalesce(haystack, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / F.lit(len(term))).cast("int")


def contains_any(columns: list[Column], terms: list[str]) -> Column:
    """True if any term occurs in any column, regardless of case; wildcards have no meaning."""
    found = F.lit(False)
    for c in columns:
        for t in terms:
            found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t.lower()))
    return found


def search_weight(term: str) -> float:
    """Weight of a term in metadata ranking."""
    return 1 + 0.5 * (len(term) >= 7) + 1.0 * any(c.isdigit() for c in term) + 0.6 * any(c.isupper() for c in term) + 0.4 * any(c in "/+-_." for c in term)


def recall_weight(term: str) -> float:
    """Weight of a term in recall, which uses other constants."""
    return 1 + 0.35 * (len(term) >= 7) + 0.6 * any(c.isdigit() for c in term) + 0.4 * any(c.isupper() for c in term) + 0.3 * any(c in "/+-_." for c in term)


def has_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff]")


def plain_summary(text: Column, size: int = 500) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)


def embedding_text(*parts: Column, size: int = 6000) -> Column:
    """Non-empty parts by line, cut at `size` characters."""
    kept = F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda p: p != "")
    return F.substring(F.array_join(kept, "\n"), 1, size)


def heuristic_tags(text: Column, keywords: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords]))


def cluster_id(tags: Column) -> Column:
    """First 24 hexadecimal digits of the SHA-1 of the sorted tags, joined by a bar."""
    return F.substring(F.sha1(F.array_join(F.sort_array(tags), "|").cast("binary")), 1, 24)


def safe_name(name: Column) -> Column:
    """A portable file name: path and control characters become underscores, dots and blanks at the end go."""
    cleaned = F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_")
    cleaned = F.regexp_replace(cleaned, r"[. ]+$", "")
    return F.when(F.length(cleaned) == 0, F.lit("untitled")).otherwise(cleaned)


def inner_name(name: Column) -> tuple[Column, Column]:
    """Name without a compression suffix, and the suffix; compound archive suffixes stay whole."""
    compound = F.lower(name).rlike(r"\.(tar\.(gz|bz2|xz|zst)|tgz|tbz2|txz)$")
    suffix = F.when(compound, F.lit("")).otherwise(F.regexp_extract(F.lower(name), r"\.(gz|bz2|xz|zst|lz4)$", 1))
    inner = F.when(suffix == "", name).otherwise(F.regexp_replace(name, r"(?i)\.(gz|bz2|xz|zst|lz4)$", ""))
    return inner, suffix


def html_text(html: Column, drop_scripts: bool = False) -> Column:
    """Text of HTML by line: some start tags begin a line, list items get a dash, blanks and empty lines go.

    Scripts and styles count as text unless `drop_scripts`.
    """
    t = F.coalesce(html, F.lit(""))
    if drop_scripts:
        t = F.regexp_replace(t, r"(?is)<(script|style)[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<li(\s[^>]*)?>", "\n- ")
    t = F.regexp_replace(t, r"(?i)<(br|p|div|tr|h[1-6])(\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[!/a-zA-Z][^>]*>", "")
    for code, mark in ENTITIES:
        t = F.replace(t, F.lit(code), F.lit(mark))
    t = F.regexp_replace(t, r"[ \t\x0B\f\r]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def time_stamp(line: Column) -> Column:
    """First ISO time in a line, without zone; null where there is none."""
    found = F.regexp_extract(line, r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})", 0)
    return F.try_to_timestamp(F.replace(found, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def any_time_stamp(line: Column, year: int) -> Column:
    """The ISO time of a line, else a web server's, else a system log's, which has no year of its own."""
    web = F.regexp_extract(line, r"\[(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2})", 1)
    system = F.regexp_replace(F.regexp_extract(line, r"^([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2})", 1), r"\s+", " ")
    web_time = F.try_to_timestamp(web, F.lit("dd/MMM/yyyy:HH:mm:ss")).cast("timestamp_ntz")
    system_time = F.try_to_timestamp(F.concat(F.lit(f"{year} "), system), F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz")
    return F.coalesce(time_stamp(line), web_time, system_time)


def level(line: Column) -> Column:
    """Log level by the strongest word found."""
    def has(words: str) -> Column:
        return line.rlike(rf"(?i)\b({words})\b")

    return (
        F.when(has("FATAL|CRITICAL|PANIC"), "FATAL").when(has("ERROR|ERR|SEVERE"), "ERROR").when(has("WARN|WARNING"), "WARN").when(has("INFO|NOTICE"), "INFO").when(has("DEBUG|TRACE"), "DEBUG")
    )


def has_level(line: Column, wanted: str) -> Column:
    """True if a word of the line is the level; WARN also matches longer words that start with it."""
    words = F.split(F.upper(line), "[^A-Z]+")
    if wanted.upper() == "WARN":
        return F.exists(words, lambda w: w.startswith("WARN"))
    return F.array_contains(words, wanted.upper())


def python_pattern(pattern: str) -> str:
    """A Python pattern for Java: names of groups are written without the P."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
