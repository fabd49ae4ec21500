"""Members of containers, what is told of a document without a model, and search with what is related."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.binding import Store, with_store
from quern.operators import answers, graph, members
from quern.operators import store as ops
from quern.plans.lineage import written
from quern.queries import metadata as md
from quern.queries import query
from quern.queries.relations import walk_sql

#: Every document is a member of its source.
_MEMBERS = "SELECT source AS container, doc_id AS position, concat(lang, '/', doc_id, '.txt') AS path, n_chars AS size, text FROM {d}"
_GLOBS = (None, "*1.txt", "en/*", "[d-e]?/*5*")
_ASKED = "SELECT item_id AS request, concat('src', item_id % 23) AS container, CASE item_id % 4 " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(_GLOBS) if g) + " END AS glob, item_id % 60 AS {limit}, (item_id % 7 - 1) * 3 AS {offset} FROM {b}"


@query(
    "d14_member_list",
    f"""WITH m AS ({_MEMBERS.format(d="documents")}), q AS ({_ASKED.format(b="benchmark", limit="most", offset="skipped")}), r AS (SELECT request, container, request % 4 AS kind, CASE WHEN most = 0 THEN 200 ELSE most END AS most, greatest(skipped, 0) AS skipped FROM q),
  k AS (SELECT request, most, skipped, path, size, row_number() OVER (PARTITION BY request ORDER BY position) AS place FROM r JOIN m USING (container)
    WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN ends_with(path, '1.txt') WHEN 2 THEN starts_with(path, 'en/') ELSE path[1] IN ('d', 'e') AND path[3] = '/' AND contains(path[4:], '5') END),
  t AS (SELECT request, count(*) AS total, count(*) FILTER (WHERE place > skipped AND place <= skipped + most) AS n, string_agg(path || ':' || size, ',' ORDER BY place) FILTER (WHERE place > skipped AND place <= skipped + most) AS matches FROM k GROUP BY request)
  SELECT request, CAST(coalesce(n, 0) AS INTEGER) AS count, CAST(coalesce(total, 0) AS BIGINT) AS total, coalesce(total, 0) > skipped + coalesce(n, 0) AS has_more, CASE WHEN coalesce(total, 0) > skipped + coalesce(n, 0) THEN CAST(skipped + coalesce(n, 0) AS BIGINT) END AS next_offset, coalesce(matches, '') AS matches
  FROM r LEFT JOIN t USING (request)""",
)
def member_list(s: Store) -> DataFrame:
    """Each benchmark item asks for a page of one source, by one of four patterns; three of 23 sources aren't there."""
    held = s.spark.sql(_MEMBERS, d=s.raw("documents")).drop("text")
    asked = s.spark.sql(_ASKED.format(b="{b}", limit="`limit`", offset="`offset`"), b=s.raw("benchmark"))
    return members.listing(held, asked).withColumn("matches", F.array_join(F.transform("matches", lambda m: F.concat(m["path"], F.lit(":"), m["size"])), ","))


#: A read of each document: lines, bytes, whole, a wrong range, another unit; every eleventh by a path that isn't there.
_READS = """SELECT doc_id AS request, source AS container, concat(CASE WHEN doc_id % 11 = 4 THEN 'no/' ELSE '' END, lang, '/', doc_id, '.txt') AS path,
  CASE doc_id % 5 WHEN 0 THEN 'lines' WHEN 1 THEN 'bytes' WHEN 3 THEN 'lines' WHEN 4 THEN 'pages' END AS unit, CASE doc_id % 5 WHEN 0 THEN '2-4' WHEN 1 THEN '7-66' WHEN 3 THEN '2' END AS value FROM {d}"""


@query(
    "d13_member_reads",
    r"""WITH l AS (SELECT *, list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x, i: NOT (x = '' AND i = len(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')))) AS lines, doc_id % 5 AS u FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
  SELECT doc_id AS request, CASE WHEN doc_id % 11 = 4 THEN NULL WHEN u = 0 THEN array_to_string(lines[2:4], chr(10)) WHEN u = 2 THEN substring(text, 1, 32000) END AS text, CASE WHEN doc_id % 11 <> 4 AND u = 1 THEN hex(encode(text))[15:134] END AS bytes,
    CASE WHEN doc_id % 11 <> 4 AND u = 0 THEN CAST(len(lines[2:4]) AS INTEGER) END AS line_count, CASE WHEN doc_id % 11 = 4 THEN 'path not found in container' WHEN u = 3 THEN 'value must be ''start-end''' WHEN u = 4 THEN 'unknown unit' END AS error FROM l""",
)
def member_reads(s: Store) -> DataFrame:
    """Bytes are compared before their broken ends are mended, which SQL can't do; tests compare those."""
    docs = s.raw("documents")
    reads = members.read(s.spark.sql(_MEMBERS, d=docs), s.spark.sql(_READS, d=docs))
    raw = docs.select(F.col("doc_id").alias("request"), F.when(F.col("doc_id") % 5 == 1, F.hex(members.byte_range(F.coalesce("text", F.lit("")), F.lit(7), F.lit(66)))).alias("_raw"))
    rows = reads.join(raw, "request").withColumn("bytes", F.when(F.col("error").isNull(), F.col("_raw")))
    return rows.select("request", F.when(F.col("_raw").isNull(), F.col("text")).alias("text"), "bytes", "line_count", "error")


@query(
    "f27_compact_coverage",
    """SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN '{"unit":"lines","total_chars":' || n_chars || CASE WHEN doc_id % 5 = 1 THEN ',"indexed_partial":' || (n_chars > 400) || ',"partial_reasons":["byte_cap","log_sample"],"ocr_used":null' ELSE '' END || '}' END AS coverage FROM documents""",
)
def compact_coverage(s: Store) -> DataFrame:
    """Two forms of coverage with keys that aren't told, one with those alone, one that is no object, one that is no JSON."""
    some = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit(', "ocr_used": null, "partial_reasons": ["byte_cap", "log_sample"], "indexed_partial": '), (F.col("n_chars") > 400).cast("string"))).otherwise("")
    told = F.concat(F.lit('{"total_chars": 9, "coverage": {"key": "k", "total_chars": '), "n_chars", F.lit(', "unit": "lines"'), some, F.lit(', "pages": {"unit": 1}}}'))
    description = F.when(F.col("doc_id") % 5 <= 1, told).when(F.col("doc_id") % 5 == 2, '{"coverage": {"other": 1}}').when(F.col("doc_id") % 5 == 3, '{"coverage": "unit"}').otherwise("coverage: unit")
    return s.raw("documents").select("doc_id", answers.compact_coverage(description).alias("coverage"))


_PLAIN = "SELECT doc_id, text, CASE WHEN doc_id % 7 <> 3 THEN 'text' END AS kind, concat(CASE WHEN doc_id % 6 = 1 THEN 'Rollback ' ELSE '' END, doc_id) AS name, CASE WHEN doc_id % 4 = 1 THEN 'text/x-support' END AS mime, '.txt' AS ext FROM {d}"


@query(
    "d17_plain_index",
    rf"""WITH RECURSIVE d AS ({_PLAIN.format(d="documents")}), t AS (SELECT *, CASE WHEN text = '' OR text IS NULL THEN 0 ELSE len(a) - CAST(a[-1] = '' AS INT) END AS n FROM (SELECT *, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS a FROM d)),
  l AS (SELECT doc_id, i, length(a[i]) + 1 AS cost FROM t, unnest(range(1, n + 1)) u(i) WHERE length(text) > 12000),
  r AS (SELECT doc_id, i, 1 AS chunk, cost AS size FROM l WHERE i = 1 UNION ALL SELECT l.doc_id, l.i, CASE WHEN size + cost > 50000 THEN chunk + 1 ELSE chunk END, CASE WHEN size + cost > 50000 THEN cost ELSE size + cost END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
  c AS (SELECT doc_id, max(chunk) AS chunks FROM r GROUP BY doc_id), w AS (SELECT unnest(['release', 'rollback', 'security', 'support', 'deploy', 'incident']) AS word, unnest(range(1, 7)) AS place),
  g AS (SELECT doc_id, string_agg('topic:' || word, ',' ORDER BY place) AS topics FROM t JOIN w ON contains(lower(name || ' ' || coalesce(mime, '') || ' .txt ' || coalesce(kind, '') || ' ' || substring(coalesce(text, ''), 1, 4000)), word) GROUP BY doc_id)
  SELECT doc_id, coalesce(nullif(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 500), ''), concat('No ', kind, ' content extracted.')) AS summary, concat_ws(',', topics, CASE WHEN kind IS NOT NULL THEN 'form:' || kind WHEN topics IS NULL THEN 'form:document' END) AS tags,
    '1-' || greatest(n, 1) AS anchor, CAST(coalesce(chunks, 1) AS INTEGER) AS chunk_count, coalesce(chunks, 1) > 1 AS chunked FROM t LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)""",
)
def plain_index(s: Store) -> DataFrame:
    rows = answers.plain_index(s.spark.sql(_PLAIN, d=s.raw("documents")))
    return rows.withColumn("tags", F.array_join(F.transform("tags", lambda t: F.concat(t["facet"], F.lit(":"), t["name"])), ","))


_FOUND = f"""SELECT entry_id, display_name, updated_at, CAST(round(CAST({md._score()} AS DOUBLE) + coalesce(CAST(bonus AS DOUBLE), 0), 6) AS DOUBLE) AS score
  FROM (SELECT live.*, body FROM live JOIN files USING (file_id)) LEFT JOIN ({md._BONUS}) USING (entry_id) WHERE {md._ANY}"""
_RELATED = (
    f""", hits AS (SELECT entry_id, score, CAST(row_number() OVER (ORDER BY score DESC, updated_at DESC, entry_id) AS INTEGER) AS place FROM ({_FOUND}) QUALIFY place <= 25),
  judged AS (SELECT x.entry_id AS a, y.entry_id AS b, count(*) AS observation_count FROM mentions x JOIN mentions y ON x.id = y.id AND x.entry_id < y.entry_id WHERE (x.entry_id + y.entry_id) % 4 <> 0 GROUP BY ALL HAVING count(*) >= 2)"""
    + walk_sql("judged", "SELECT entry_id AS seed FROM hits WHERE place <= 10 AND entry_id IN (SELECT src FROM both_ways)")
    + """, best AS (SELECT seed, node, visits / sum(visits) OVER (PARTITION BY seed) AS score FROM v), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, node) AS INTEGER) AS nth FROM best QUALIFY nth <= 3)
  SELECT h.entry_id, h.score, h.place, top.nth, top.node AS related_id, CASE WHEN top.node IS NOT NULL THEN coalesce(e.display_name, '') END AS related_name, round(top.score, 4) AS related_score FROM hits h LEFT JOIN top ON top.seed = h.entry_id LEFT JOIN entries e ON e.entry_id = top.node"""
)


@query("h09_search_related", md._sql("", "entry_tags", "mentions").rstrip() + _RELATED)
def search_related(s: Store) -> DataFrame:
    """The best 25 hits of a search, the first ten with what walks over pairs from notes, judged ones, visit most; a row each."""
    found = ops.search_metadata(ops.live(s.entries, s.files), md.QUERY, s.entry_tags, md.FIELDS, md.REQUESTED, limit=25).select("entry_id", "score", "updated_at")
    place = F.row_number().over(W.orderBy(F.col("score").desc(), F.col("updated_at").desc(), "entry_id"))  # over 25 rows
    judged = written(graph.pair_counts(s.mentions, 2).filter("(a + b) % 4 <> 0"))
    rows = graph.with_related(written(found.withColumn("place", place).drop("updated_at")), judged, s.entries)
    return rows.select("entry_id", "score", "place", F.posexplode_outer("related").alias("_at", "r")).select(
        "entry_id", "score", "place", (F.col("_at") + 1).alias("nth"), F.col("r.entry_id").alias("related_id"), F.col("r.display_name").alias("related_name"), F.col("r.score").alias("related_score")
    )
