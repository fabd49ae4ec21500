"""Reads of parts of texts: each request names a pattern, a section, a heading, lines or an offset, and has its own answer.

Requests meet their texts in one join. What a request can do wrong (a pattern that isn't one, lines in the wrong order, a
section that isn't there) is an error in its own row; no request stops another.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a read, matches of a page of them, lines of context, characters of a match and of an unmarked section.
MAX_CHARS, MAX_MATCHES, CONTEXT_LINES, MATCH_CHARS, SCAN_CHARS = 8000, 20, 2, 200, 4096
#: What may follow a heading's start in a longer one; the characters that end a numbered chapter.
AFTER_START, CHAPTER_ENDS = ":：-–—.。)）]】", "章节部篇回卷"
HEADING = re.compile(r"\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$")

ARGUMENTS = {
    "pattern": "string", "section_id": "string", "heading": "string", "line_start": "int", "line_end": "int", "offset": "int", "max_chars": "int", "context_lines": "int", "max_matches": "int", "match_offset": "int",
}
_OUT = "how string, part string, error string, first_line int, last_line int, total int, next int"


class Refused(ValueError):
    """The request can't be answered."""


def _same_heading(title: str, asked: str) -> bool:
    plain = lambda s: re.sub(r"^\s*#{1,6}\s+", "", re.sub(r"\s+", " ", s.strip())).casefold()
    title, asked = plain(title), plain(asked)
    if not title or not asked:
        return False
    rest = title[len(asked) :]
    if title.startswith(asked) and (not rest or rest[0].isspace() or rest[0] in AFTER_START):
        return True
    tight = asked.replace(" ", "")
    return tight[-1] in CHAPTER_ENDS and title.replace(" ", "").startswith(tight)


def _next_heading(text: str, at: int, depth: int) -> int:
    found = re.compile(rf"(?m)^\s{{0,3}}#{{1,{depth}}}\s+\S").search(text, at)
    return found.start() if found else len(text)


def _lines(lines: list[str], first: int | None, last: int | None, otherwise: int) -> tuple[int, int]:
    first = max(1, first or 1)
    last = last or (first if otherwise == 0 else otherwise)
    if last < first:
        raise Refused("line_end must be >= line_start")
    return first, last


def _page(text: str, asked: dict, **more) -> dict:
    """The piece of a text from the offset that the request asks for."""
    at, most = max(0, asked["offset"] or 0), asked["max_chars"] if (asked["max_chars"] or 0) > 0 else MAX_CHARS
    piece = text[at : at + most]
    return {"part": piece, "total": len(text), "next": at + len(piece) if at + len(piece) < len(text) else None} | more


def _matches(text: str, asked: dict) -> dict:
    lines = text.splitlines()
    before = 0
    if asked["line_start"] or asked["line_end"]:
        first, last = _lines(lines, asked["line_start"], asked["line_end"], max(1, len(lines)))
        lines, before = lines[first - 1 : last], first - 1
        text = "\n".join(lines)
    try:
        found = list(re.compile(asked["pattern"].strip(), re.I | re.M).finditer(text))
    except re.error as e:
        raise Refused(f"invalid regex: {e}") from e
    skipped = max(0, asked["match_offset"] or 0)
    page = found[skipped : skipped + (asked["max_matches"] or MAX_MATCHES)]
    if not page:
        raise Refused(f"match_offset {skipped} exceeds total_matches {len(found)}" if skipped and found else "no matches")
    around = asked["context_lines"] or CONTEXT_LINES
    starts = [0, *accumulate(map(len, text.splitlines(keepends=True)))][: max(1, len(lines))]
    shown = []
    for m in page:
        line = bisect_right(starts, m.start())
        shown.append((line + before, f"[L{line + before}] {m.group(0)[:MATCH_CHARS]}\n  ┊ " + "\n".join(lines[max(0, line - 1 - around) : line + around])))
    more = skipped + len(page)
    return {"part": "\n\n".join(s for _, s in shown), "first_line": shown[0][0], "last_line": shown[-1][0], "total": len(found), "next": more if more < len(found) else None}


def _section_text(section: dict, text: str) -> str | None:
    """What a section of the map is in the text: the lines of its anchor, else from its title on; None if it isn't there."""
    anchor = section["anchor"] or {}
    if anchor.get("unit") == "lines" and (span := re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", anchor.get("value") or "")):
        return "\n".join(text.splitlines()[max(0, int(span[1]) - 1) : int(span[2])])
    title = (section["title"] or "").strip()
    at = text.find(title) if title else -1
    if at < 0:
        return None
    line = text[text.rfind("\n", 0, at) + 1 :].partition("\n")[0]
    head = re.match(r"\s{0,3}(#{1,6})\s+\S", line)
    if not head:
        return text[at : at + SCAN_CHARS]
    behind = text.find("\n", at)
    end = len(text) if behind < 0 else _next_heading(text, behind + 1, len(head[1]))
    return text[at : min(end, at + SCAN_CHARS)].rstrip()


def _titled(text: str, asked: dict, sections: list[dict] | None) -> dict:
    section_id, heading = (asked["section_id"] or "").strip(), (asked["heading"] or "").strip()
    ranked = [lambda s: section_id and s["id"] == section_id, lambda s: heading and (s["title"] or "").strip() == heading, lambda s: heading and _same_heading(s["title"] or "", heading)]
    target = next((s for rule in ranked for s in sections or [] if rule(s)), None)
    if target is not None:
        body = _section_text(target, text)
        return _page(body or "", asked) if body is not None else {"part": "", "total": 0}
    at = 0
    for number, line in enumerate(text.splitlines(keepends=True) if heading else [], 1):
        found = HEADING.match(line.rstrip("\r\n"))
        if found and _same_heading(found[2], heading):
            body = text[at : _next_heading(text, at + len(line), len(found[1]))].rstrip()
            return _page(body, asked, first_line=number, last_line=number + body.count("\n"))
        at += len(line)
    if section_id and sections is None:
        raise Refused("section_id lookup needs a map of sections")
    raise Refused(f"section not found: {section_id or heading}")


def read_one(text: str, asked: dict, sections: list[dict] | None = None) -> dict:
    """One request's answer; the first locator that it names decides."""
    how = "chunk"
    try:
        if (asked["pattern"] or "").strip():
            how = "pattern"
            return {"how": how} | _matches(text, asked)
        if (asked["section_id"] or "").strip() or (asked["heading"] or "").strip():
            how = "section" if (asked["section_id"] or "").strip() else "heading"
            made = _titled(text, asked, sections)
        elif asked["line_start"] or asked["line_end"]:
            how = "lines"
            lines = text.splitlines()
            first, last = _lines(lines, asked["line_start"], asked["line_end"], 0)
            made = _page("\n".join(lines[first - 1 : last]), asked, first_line=first, last_line=last)
        else:
            at = max(0, asked["offset"] or 0)
            first = text[:at].count("\n") + 1
            made = _page(text, asked, first_line=first)
            return {"how": how} | made | {"last_line": first + made["part"].count("\n")}
        # a section whose place isn't known answers with nothing, a read past the end is an error
        return {"how": how} | made | ({"error": "empty result"} if not made["part"] and "next" in made else {})
    except Refused as e:
        return {"how": how, "part": "", "error": str(e)}


def read_segments(docs: DataFrame, requests: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """request_id, how, part, error, first_line, last_line, total and next of each request for a part of a document.

    `docs` has doc_id and text (null: empty); `requests` has request_id, doc_id and any of ARGUMENTS (null or not there: not
    named); `sections` is a map of sections (doc_id, position, id, title, anchor), as normal_sections makes it. In order:
    a pattern (Python's, without case; in the named lines only) gives a page of matches with lines around them, `total` all
    matches, `next` the offset of the next page; a section by id, title or like title; a heading in the text, up to the next one
    as deep; lines line_start to line_end, of which a missing start is 1 and a missing end the start; else the text. Reads but
    those of patterns are pieces of `max_chars` from `offset`. Requests for documents that aren't there give no row.
    """
    named = set(requests.columns)
    fields = [F.col(n).cast(t).alias(n) if n in named else F.lit(None).cast(t).alias(n) for n, t in ARGUMENTS.items()]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    if sections is not None:
        kept = F.array_sort(F.collect_list(F.struct("position", "id", "title", F.to_json("anchor").alias("anchor"))))
        texts = texts.join(sections.groupBy("doc_id").agg(kept.alias("_sections")), "doc_id", "left")
    else:
        texts = texts.withColumn("_sections", F.lit(None).cast("array<struct<position:int,id:string,title:string,anchor:string>>"))
    rows = requests.select("request_id", "doc_id", F.struct(*fields).alias("_asked")).join(texts, "doc_id").select("request_id", "_asked", "_text", F.to_json("_sections").alias("_sections"))
    kind = dict(requests.dtypes)["request_id"]
    names = [c.strip().split(" ")[0] for c in _OUT.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            out = []
            for asked, text, known in zip(batch["_asked"].to_dict("records") if isinstance(batch["_asked"], pd.DataFrame) else batch["_asked"], batch["_text"], batch["_sections"]):
                asked = {k: None if v is None or v != v else int(v) if ARGUMENTS[k] == "int" else v for k, v in dict(asked).items()}
                known = None if known is None else [{"id": None, "title": None} | s | {"anchor": json.loads(s["anchor"]) if s.get("anchor") else None} for s in json.loads(known)]
                out.append(read_one(text, asked, known))
            made = pd.DataFrame(out, columns=names)
            made.insert(0, "request_id", batch["request_id"].to_numpy())
            yield made.astype({n: "Int32" for n in ("first_line", "last_line", "total", "next")})

    return rows.mapInPandas(read, f"request_id {kind}, {_OUT}")
