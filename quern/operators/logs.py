"""Log lines: scope, filter, pattern counts, captured values, histograms. Lines are rows of line_no and text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import has_level, python_pattern, time_stamp
from quern.functions.text import level as detected

#: A pattern longer than this is refused: Java's engine has no bound on its time.
MAX_PATTERN = 1000


def checked(pattern: str) -> str:
    if len(pattern) > MAX_PATTERN:
        raise ValueError(f"pattern of more than {MAX_PATTERN} characters")
    return python_pattern(pattern)


def scope(lines: DataFrame, level: str | None = None, since: str | None = None, until: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Lines of a range, level and time (since inclusive, until exclusive); a line without a time fails any bound."""
    if first is not None:
        lines = lines.filter(F.col("line_no") >= first)
    if last is not None:
        lines = lines.filter(F.col("line_no") <= last)
    if level:
        lines = lines.filter(has_level(F.col("text"), level))
    if since or until:
        lines = lines.withColumn("_ts", time_stamp(F.col("text")))
        if since:
            lines = lines.filter(F.col("_ts") >= F.lit(since).cast("timestamp_ntz"))
        if until:
            lines = lines.filter(F.col("_ts") < F.lit(until).cast("timestamp_ntz"))
        lines = lines.drop("_ts")
    return lines


def matching(lines: DataFrame, pattern: str, regex: bool = True) -> DataFrame:
    """Lines that match; a literal is looked for regardless of case."""
    if regex:
        return lines.filter(F.col("text").rlike(checked(pattern)))
    return lines.filter(F.contains(F.lower("text"), F.lit(pattern.lower())))


def count_pattern(lines: DataFrame, pattern: str) -> DataFrame:
    """total_lines, match_count and percent (four digits) of the lines."""
    hit = F.count_if(F.col("text").rlike(checked(pattern)))
    total = F.count(F.lit(1))
    percent = F.when(total > 0, F.round(100.0 * hit / F.nullif(total, F.lit(0)), 4)).otherwise(F.lit(0.0))
    return lines.agg(total.alias("total_lines"), hit.alias("match_count"), percent.alias("percent"))


def captured(pattern: str) -> int:
    """The group that counts: a named one, the last if there are more, else the first, else the whole match."""
    groups = re.compile(pattern)
    return max(groups.groupindex.values(), default=min(1, groups.groups))


def top_values(lines: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """Captured values by count, ties by where they first occur. Every capture counts, also several in a line."""
    found = F.regexp_extract_all("text", F.lit(checked(pattern)), F.lit(captured(pattern)))
    values = lines.select("line_no", F.posexplode(found).alias("at", "value"))
    counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "at")).alias("_first"))
    return counted.orderBy(F.col("n").desc(), "_first").limit(limit).select("value", "n")


def histogram(lines: DataFrame, pattern: str | None, bucket: str = "hour", limit: int = 1000) -> DataFrame:
    """Matches by day or hour, the earliest buckets first; lines without a time are left out."""
    if pattern:
        lines = lines.filter(F.col("text").rlike(checked(pattern)))
    shape = {"hour": "yyyy-MM-dd'T'HH:00", "day": "yyyy-MM-dd"}[bucket]
    stamped = lines.select(F.date_format(time_stamp(F.col("text")), shape).alias("bucket")).filter("bucket IS NOT NULL")
    return stamped.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").limit(limit)


def around(lines: DataFrame, match: Column, k: int) -> DataFrame:
    """Each matching line with the k lines before and after it; neighbours meet by line number, not by a window."""
    hits = lines.filter(match).select(F.col("line_no").alias("match_no"))
    near = hits.select("match_no", F.explode(F.sequence(F.col("match_no") - k, F.col("match_no") + k)).alias("line_no"))
    return near.join(lines, "line_no").groupBy("match_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("context"))


#: Levels from the weakest to the strongest.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def at_least(lines: DataFrame, weakest: str) -> DataFrame:
    """Lines whose detected level is `weakest` or stronger."""
    return lines.filter(detected(F.col("text")).isin(*LEVELS[LEVELS.index(weakest.upper()) :]))


def pattern_hits(lines: DataFrame, pattern: str, limit: int, offset: int = 0) -> DataFrame:
    """line_no, hit (from 0), match and level of every match, several in a line counting each."""
    found = F.regexp_extract_all("text", F.lit(checked(pattern)), F.lit(0))
    rows = lines.select("line_no", detected(F.col("text")).alias("level"), F.posexplode(found).alias("hit", "match"))
    return rows.orderBy("line_no", "hit").offset(offset).limit(limit).select("line_no", "hit", "match", "level")
