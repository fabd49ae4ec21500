"""Members of containers (archives, folders): listed by pattern and page, read whole, by lines or by bytes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.plans import ordered

#: Members on a page where none are asked for, and at most; characters of a member that is read whole.
PAGE, MOST, WHOLE = 200, 1000, 32_000
#: Stands for any place further on than a text can reach.
FAR = 2**31 - 2
#: Fixed value: where a text is cut into lines.
LINE_END = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029]"


def shell_regex(pattern: str) -> str:
    """A regular expression for a whole path: `*` is any text, also over folders, `?` one character, `[a-c]` and `[!a-c]` sets.

    A bracket that is never closed is plain text; a range that runs backwards holds nothing.
    """
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        closed = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!")) if c == "[" else -1
        out += _set(pattern[i + 1 : closed]) if closed > 0 else ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i = max(i, closed) + 1
    return f"(?s)^{out}\\z"


def _set(inner: str) -> str:
    """One character of a set, or not of it; the words inside are single characters and ranges."""
    none = inner.startswith("!")
    parts = re.findall(r"(?s)(.)-(.)|(.)", inner.removeprefix("!"))
    held = "".join(re.escape(one) if one else f"{re.escape(a)}-{re.escape(b)}" for a, b, one in parts if one or a <= b)
    return f"[{'^' if none else ''}{held}]" if held else "." if none else "(?!)"


@F.pandas_udf(StringType())
def _regex(pattern: pd.Series) -> pd.Series:
    return pattern.map(shell_regex, na_action="ignore")


def listing(members: DataFrame, requests: DataFrame) -> DataFrame:
    """A page of a container's members for each request: request, count, total, has_more, next_offset and matches (path, size).

    `members` has container, position (their order), path and size; `requests` has request, container, glob (null or empty:
    all), limit (null or 0: 200, at most 1000) and offset (null or negative: 0). A container that isn't there has no members. Each
    container and pattern is matched and numbered once, however many ask for it; the numbers come from ranges, so a container
    of any size is no task's alone, and a request meets only the places of its page.
    """
    asked = requests.select(
        "request", "container", F.nullif("glob", F.lit("")).alias("glob"),
        F.greatest(F.least(F.coalesce(F.nullif("limit", F.lit(0)), F.lit(PAGE)), F.lit(MOST)), F.lit(0)).cast("long").alias("_limit"),
        F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)).cast("long").alias("_offset"),
    )
    kinds = asked.select("container", "glob").distinct().withColumn("_regex", _regex("glob"))
    met = members.join(kinds, "container").filter(F.col("_regex").isNull() | F.regexp_like("path", F.col("_regex")))
    key = F.xxhash64("container", "glob").alias("_kind")  # joins by equality; the columns themselves are compared as well
    rows = ordered.running(met.select(key, "container", "glob", "position", "path", "size"), ["container", "glob"], ["position", "path"], {}, count="_place")
    totals = met.groupBy(key, F.col("container").alias("_c"), F.col("glob").alias("_g")).agg(F.count(F.lit(1)).alias("total"))
    places = asked.filter("_limit > 0").select("request", key, F.col("container").alias("_c"), F.col("glob").alias("_g"), F.explode(F.sequence(F.col("_offset") + 1, F.col("_offset") + F.col("_limit"))).alias("_place"))
    same = lambda a, b: (a["_kind"] == b["_kind"]) & a["container"].eqNullSafe(b["_c"]) & a["glob"].eqNullSafe(b["_g"])
    paged = rows.join(places, same(rows, places) & (rows["_place"] == places["_place"])).select("request", F.struct(rows["_place"].alias("place"), "path", "size").alias("_m"))
    paged = paged.groupBy("request").agg(F.array_sort(F.collect_list("_m")).alias("_m"))
    asked = asked.select("*", key)
    out = asked.join(totals, same(asked, totals), "left").join(paged, "request", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    matches = F.coalesce(F.transform("_m", lambda m: F.struct(m["path"].alias("path"), m["size"].alias("size"))), F.array().cast(f"array<struct<path:string,size:{dict(members.dtypes)['size']}>>"))
    upto = F.col("_offset") + F.size(matches)
    more = F.col("total") > upto
    return out.select("request", F.size(matches).alias("count"), "total", more.alias("has_more"), F.when(more, upto).alias("next_offset"), matches.alias("matches"))


def byte_range(text: Column, first: Column, last: Column) -> Column:
    """UTF-8 bytes first to last (from 0, both included) of a text, as binary; past the end there are none."""
    size = F.least(F.greatest(last - first + 1, F.lit(0)), F.lit(FAR))
    return F.substring(text.cast("binary"), (F.least(first, F.lit(FAR)) + 1).cast("int"), size.cast("int"))


def split_lines(text: Column) -> Column:
    """Lines without their ends; an end at the very end starts no line, and an empty text has none."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def read(members: DataFrame, requests: DataFrame) -> DataFrame:
    """What each request reads of a member: request, text, line_count and error, one of text and error null.

    `members` has container, path and text (null: empty); `requests` has request, container, path, unit and value. A null unit
    is the whole member, up to 32 000 characters. `lines` and `bytes` take `start-end`: lines count from 1, bytes from 0, both
    ends are read, and bytes that are no whole character become U+FFFD. Every other unit or value is the request's own error.
    """
    digits = lambda i: F.regexp_extract("value", r"^\s*\+?0*(\d+)\s*-\s*\+?0*(\d+)\s*$", i)
    bound = lambda i: F.when(F.length(digits(i)) > 9, F.lit(FAR)).otherwise(digits(i).try_cast("long"))
    known = members.select("container", "path", F.coalesce("text", F.lit("")).alias("_text"))
    rows = requests.select("request", "container", "path", F.coalesce("unit", F.lit("whole")).alias("unit"), F.coalesce("value", F.lit("")).alias("value"))
    rows = rows.join(known, ["container", "path"], "left").withColumns({"_first": bound(1), "_last": bound(2)})
    first = F.greatest(F.col("_first"), F.lit(1)).cast("int")
    lines = F.slice(split_lines(F.col("_text")), first, F.greatest(F.col("_last") - first + 1, F.lit(0)).cast("int"))
    ranged = F.col("unit").isin("lines", "bytes")
    error = F.when(F.col("_text").isNull(), "path not found in container").when(ranged & (F.col("_first").isNull() | F.col("_last").isNull()), "value must be 'start-end'")
    error = error.when(~ranged & (F.col("unit") != "whole"), "unknown unit")
    text = F.when(F.col("unit") == "lines", F.array_join(lines, "\n")).when(F.col("unit") == "bytes", F.make_valid_utf8(byte_range(F.col("_text"), F.col("_first"), F.col("_last")).cast("string")))
    text = text.otherwise(F.substring("_text", 1, WHOLE))
    rows = rows.withColumn("error", error)
    return rows.select("request", F.when(F.col("error").isNull(), text).alias("text"), F.when(F.col("error").isNull() & (F.col("unit") == "lines"), F.size(lines)).alias("line_count"), "error")
