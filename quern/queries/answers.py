"""Answers and what they rest on: verdicts, patterns, labels, reads, evidence, checkpoints, coverage, what is embedded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.binding import NOW, Store, with_store
from quern.functions.text import FACET_WEIGHTS, any_time_stamp
from quern.operators import answers, documents, graph, repository, segments
from quern.operators.store import ACTIVE
from quern.queries import query


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


_SAID = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '**Verdict: Insufficient**' || chr(10) WHEN 1 THEN 'It does not support ' WHEN 2 THEN 'accurate ' ELSE '' END || text AS said FROM conversations"
_STATED = r"upper(regexp_extract(said, '(?im)^\s*(?:\*\*)?\s*verdict\s*:\s*(support|contradict|insufficient)\b', 1))"


@query(
    "x40_verdicts",
    f"SELECT conv_id, turn, CASE WHEN {_STATED} <> '' THEN {_STATED} " + " ".join(f"WHEN {_any('said', words)} THEN '{name}'" for name, words in documents.VERDICT_WORDS) + f" END AS label FROM ({_SAID})",
)
def verdicts(s: Store) -> DataFrame:
    turn = F.col("turn") % 4
    lead = F.when(turn == 0, "**Verdict: Insufficient**\n").when(turn == 1, "It does not support ").when(turn == 2, "accurate ").otherwise("")
    return s.raw("conversations").select("conv_id", "turn", documents.verdict(F.concat(lead, "text")).alias("label"))


_PATTERNS = rf"""WITH w AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9+_./,-]*'), lambda x: regexp_replace(x, '^[.,]+|[.,]+$', '', 'g')),
  lambda x: x <> '' AND lower(x) NOT IN ({", ".join(f"'{w}'" for w in answers.PATTERN_STOP_WORDS)}) AND NOT (length(x) < 4 AND NOT regexp_matches(x, '[0-9A-Z]'))) AS l FROM benchmark)
  SELECT item_id, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:8], lambda x: regexp_replace(x, '([+.-])', '\\\1', 'g')), ' ') AS patterns FROM w"""


@query("x41_query_patterns", _PATTERNS)
def patterns(s: Store) -> DataFrame:
    return s.raw("benchmark").select("item_id", F.array_join(answers.query_patterns(F.col("text")), " ").alias("patterns"))


_TITLES = "CASE turn % 5 WHEN 0 THEN 'Page ' || conv_id WHEN 1 THEN ' FULL   document ' WHEN 2 THEN 'Lines 1-' || turn WHEN 3 THEN 'Section x' ELSE substring(text, 1, 20) END"


@query("x32_generic_titles", rf"SELECT conv_id, turn, regexp_full_match(trim(regexp_replace(lower({_TITLES}), '\s+', ' ', 'g')), 'document|full document|entire document|lines \d+-\d+|page \d+|section \d+|ocr page \d+') AS generic FROM conversations")
def generic_titles(s: Store) -> DataFrame:
    return s.raw("conversations").select("conv_id", "turn", answers.generic_title(F.expr(_TITLES)).alias("generic"))


_SEED = "CASE entry_id % 3 WHEN 0 THEN facet || ': ' || name WHEN 1 THEN 'odd:' || name ELSE name END"


@query("x49_tag_seeds", with_store(f"SELECT entry_id, CASE entry_id % 3 WHEN 0 THEN name WHEN 1 THEN 'odd:' || name ELSE name END AS name, CASE WHEN entry_id % 3 = 0 THEN facet END AS facet FROM entry_tags WHERE facet IN ({', '.join(repr(f) for f in FACET_WEIGHTS)})", "entry_tags"))
def tag_seeds(s: Store) -> DataFrame:
    return s.entry_tags.select("entry_id", answers.tag_seed(F.expr(_SEED)).alias("seed")).select("entry_id", "seed.*")


_PAGES = "SELECT l_orderkey AS doc_id, l_linenumber AS page, CASE WHEN l_linenumber % 3 = 0 THEN 'iv' ELSE CAST(l_linenumber + 1 AS STRING) END AS label FROM {t}"


@query(
    "x21_page_labels",
    f"""WITH p AS ({_PAGES.format(t="lineitem")}), a AS (SELECT o_orderkey AS ask_id, o_orderkey % 7 AS n FROM orders), l AS (SELECT doc_id, label, min(page) AS page FROM p GROUP BY ALL HAVING count(*) = 1),
  t AS (SELECT doc_id, count(*) AS total FROM p GROUP BY doc_id)
  SELECT ask_id, CAST(CASE WHEN n > 0 THEN coalesce(l.page, CASE WHEN n <= total THEN n END) END AS BIGINT) AS page FROM a LEFT JOIN l ON l.doc_id = ask_id AND l.label = CAST(n AS STRING) LEFT JOIN t ON t.doc_id = ask_id""",
)
def page_labels(s: Store) -> DataFrame:
    pages = s.spark.sql(_PAGES.format(t="{t}"), t=s.raw("lineitem"))
    asked = s.raw("orders").select(F.col("o_orderkey").alias("ask_id"), F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("p. "), F.col("o_orderkey") % 7).alias("value"))
    return answers.resolve_labels(pages, asked)


@query("d01b_patterns", "SELECT conv_id, turn, CAST(0 AS INTEGER) AS read, role AS pattern FROM conversations UNION ALL SELECT conv_id, turn, 1, 'assistant' FROM conversations WHERE role <> 'assistant'")
def expanded(s: Store) -> DataFrame:
    asked = s.raw("conversations").select("conv_id", "turn", F.col("role").alias("pattern"), F.array(F.lit("assistant"), F.lit(""), F.col("role")).alias("patterns"))
    return answers.expand_patterns(asked)


@query(
    "d02b_read_segments",
    """WITH d AS (SELECT doc_id, '# ' || lang || chr(10) || replace(text, '#', '') || chr(10) || '## tail ##' || chr(10) || 'end' AS t FROM documents), l AS (SELECT *, string_split(t, chr(10)) AS x, string_split(t, chr(10))[2:3] AS w FROM d),
  m AS (SELECT doc_id, i, k, regexp_extract_all(w[i], '(?i)e[nr]')[k] AS said, array_to_string(w[greatest(1, i - 1):i + 1], chr(10)) AS around FROM l, unnest(range(1, len(w) + 1)) a(i), unnest(range(1, len(regexp_extract_all(w[i], '(?i)e[nr]')) + 1)) b(k) WHERE doc_id % 6 = 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS place, count(*) OVER (PARTITION BY doc_id) AS total FROM m),
  h AS (SELECT doc_id, string_agg('[L' || (i + 1) || '] ' || said || chr(10) || '  ┊ ' || around, chr(10) || chr(10) ORDER BY place) AS part, min(i) + 1 AS first, max(i) + 1 AS last, any_value(total) AS total FROM n WHERE place IN (2, 3) GROUP BY doc_id),
  s AS (SELECT l.doc_id, l.doc_id % 6 AS kind, t, x, h.part, h.first, h.last, h.total, (SELECT count(*) FROM m WHERE m.doc_id = l.doc_id) AS found FROM l LEFT JOIN h ON h.doc_id = l.doc_id)
  SELECT doc_id AS request_id, ['pattern', 'heading', 'lines', 'chunk', 'pattern', 'lines'][kind + 1] AS how,
    CASE kind WHEN 0 THEN coalesce(part, '') WHEN 1 THEN substring('## tail ##' || chr(10) || 'end', 4, 300) WHEN 2 THEN substring(array_to_string(x[1:1], chr(10)), 4, 300) WHEN 3 THEN substring(t, 11, 300) ELSE '' END AS part,
    CASE kind WHEN 0 THEN CASE WHEN found = 0 THEN 'no matches' WHEN found = 1 THEN 'match_offset 1 exceeds total_matches 1' END WHEN 4 THEN 'invalid regex' WHEN 5 THEN 'line_end must be >= line_start' END AS error,
    CAST(CASE kind WHEN 0 THEN first WHEN 1 THEN len(x) - 1 WHEN 2 THEN 1 WHEN 3 THEN 1 + length(substring(t, 1, 10)) - length(replace(substring(t, 1, 10), chr(10), '')) END AS INTEGER) AS first_line,
    CAST(CASE kind WHEN 0 THEN last WHEN 1 THEN len(x) WHEN 2 THEN 1 WHEN 3 THEN 1 + length(substring(t, 1, 310)) - length(replace(substring(t, 1, 310), chr(10), '')) END AS INTEGER) AS last_line,
    CAST(CASE kind WHEN 0 THEN total WHEN 1 THEN 14 WHEN 2 THEN length(x[1]) WHEN 3 THEN length(t) END AS INTEGER) AS total,
    CAST(CASE WHEN kind = 0 AND total > 3 THEN 3 WHEN kind = 3 AND length(t) > 310 THEN 310 END AS INTEGER) AS next FROM s""",
)
def read_parts(s: Store) -> DataFrame:
    d = s.raw("documents")
    docs = d.select("doc_id", F.concat(F.lit("# "), "lang", F.lit("\n"), F.replace("text", F.lit("#"), F.lit("")), F.lit("\n## tail ##\nend")).alias("text"))
    kind = F.col("doc_id") % 6
    asked = d.select(
        F.col("doc_id").alias("request_id"), "doc_id", F.when(kind == 0, "e[nr]").when(kind == 4, "(").alias("pattern"), F.when(kind == 1, " TAIL ").alias("heading"), F.when(kind == 0, 2).when(kind == 5, 9).alias("line_start"),
        F.when(kind == 0, 3).when(kind == 2, 1).when(kind == 5, 4).alias("line_end"), F.when(kind.isin(1, 2), 3).when(kind == 3, 10).alias("offset"), F.lit(300).alias("max_chars"), F.lit(1).alias("context_lines"), F.lit(2).alias("max_matches"), F.lit(1).alias("match_offset"),
    )
    rows = segments.read_segments(docs, asked)
    return rows.withColumn("error", F.when(F.col("error").startswith("invalid regex"), "invalid regex").otherwise(F.col("error")))


def _plain_sql(text: str) -> str:
    """`documents.plain_quote` in SQL, which has no compatibility forms: the given texts are their own."""
    return rf"regexp_replace(replace(lower({text}), 'ß', 'ss'), '[\s\p{{P}}\p{{Z}}\p{{C}}]', '', 'g')"


_QUOTE = "CASE doc_id % 3 WHEN 0 THEN upper(substring(text, 11, 40)) WHEN 1 THEN 'never said so' ELSE substring(text, 3, 30) END"


_READS = """SELECT doc_id AS turn, source AS entry_id, CASE WHEN doc_id % 4 < 2 THEN n_chars % 5 + 1 END AS page_start, CASE doc_id % 4 WHEN 0 THEN n_chars % 5 + 3 END AS page_end, CASE WHEN doc_id % 4 = 2 THEN 9 END AS slide_start,
  CASE WHEN doc_id % 3 = 0 THEN concat('[Page 4]', {nl}, 'first', {nl}, '[OCR Page 6]', {nl}, replace(text, '#', ''), {nl}, '# Slide 8: last', {nl}, 'end') ELSE replace(text, '#', '') END AS text FROM {t}"""


@query(
    "d19_quoted_evidence",
    rf"""WITH c AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 7 = 2 THEN 4 WHEN doc_id % 7 = 5 THEN 6 END AS claimed, {_plain_sql(f"replace({_QUOTE}, '#', '')")} AS quote, doc_id % 3 <> 1 AND {_plain_sql(f"replace({_QUOTE}, '#', '')")} <> '' AS supported FROM documents),
  p AS (SELECT *, CASE WHEN NOT supported THEN [] WHEN doc_id % 3 = 0 THEN list_concat([6], CASE WHEN contains('first', quote) THEN [4] ELSE [] END, CASE WHEN contains('end', quote) THEN [8] ELSE [] END) WHEN doc_id % 4 = 1 THEN [n_chars % 5 + 1] WHEN doc_id % 4 = 2 THEN [9] ELSE [] END AS seen FROM c)
  SELECT doc_id AS cite_id, supported, NOT supported OR claimed IS NULL OR list_contains(seen, claimed) AS page_supported, CAST(CASE WHEN claimed IS NULL THEN CASE WHEN len(seen) = 1 THEN seen[1] END WHEN list_contains(seen, claimed) THEN claimed END AS BIGINT) AS page FROM p""",
)
def evidence(s: Store) -> DataFrame:
    d = s.raw("documents")
    reads = s.spark.sql(_READS.format(t="{t}", nl="chr(10)"), t=d).withColumn("slide_end", F.lit(None).cast("int"))
    claimed = F.when(F.col("doc_id") % 7 == 2, 4).when(F.col("doc_id") % 7 == 5, 6)
    cites = d.select(F.col("doc_id").alias("cite_id"), F.col("doc_id").alias("turn"), F.col("source").alias("entry_id"), F.replace(F.expr(_QUOTE), F.lit("#"), F.lit("")).alias("quote"), claimed.alias("page"))
    return answers.quoted_evidence(cites, reads)


def _bounded(column: str, most: int) -> str:
    return f"CASE WHEN length(trim({column})) <= {most} THEN trim({column}) ELSE rtrim(substring(trim({column}), 1, {most})) || '…' END"


_LEAD = "CASE WHEN turn = 0 THEN 'You must answer. ' ELSE 'We decided so. Next: look! ' END || text"
_EMPTY = '{"version": 1, "goal": [], "constraints": [], "progress": [], "key_decisions": [], "next_steps": [], "critical_context": [], "evidence_entry_ids": [], "evidence": [], "scopes": [], "tool_history": []}'
_BUDGET = 1200
_CHECKPOINT = rf"""WITH c AS (SELECT conv_id, turn, role, {_LEAD} AS text FROM conversations),
  l AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?。！？；])\s*', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM c),
  s AS (SELECT conv_id, turn, role, i AS pos, l[i] AS s FROM l, unnest(range(1, len(l) + 1)) t(i)),
  i AS (SELECT conv_id, 'goal' AS kind, 0 AS phase, turn, 0 AS pos, {_bounded("text", 2000)} AS said FROM c WHERE role = 'user'
    UNION ALL SELECT conv_id, 'progress', 0, turn, 0, {_bounded("text", 2500)} FROM c WHERE role <> 'user'
    UNION ALL SELECT conv_id, 'constraints', 4, turn, pos, {_bounded("s", 800)} FROM s WHERE role = 'user' AND {_any("s", answers.CONSTRAINT_TERMS)}
    UNION ALL SELECT conv_id, 'key_decisions', 3, turn, pos, {_bounded("s", 1000)} FROM s WHERE role <> 'user' AND {_any("s", answers.DECISION_TERMS)}
    UNION ALL SELECT conv_id, 'next_steps', 5, turn, pos, {_bounded("s", 1000)} FROM s WHERE role <> 'user' AND {_any("s", answers.NEXT_TERMS)}),
  f AS (SELECT conv_id, kind, phase, said, min((turn, pos)) AS first FROM i WHERE said <> '' GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY first DESC, said DESC) AS age FROM f),
  p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE kind WHEN 'progress' THEN CASE age WHEN 1 THEN 8 ELSE 1 END WHEN 'goal' THEN CASE age WHEN 1 THEN 9 ELSE 2 END ELSE phase END, age DESC) AS gone FROM r),
  d AS (SELECT conv_id, unnest(range(0, count(*) + 1)) AS d FROM p GROUP BY conv_id),
  own AS (SELECT d.conv_id, d.d, sum(strlen(to_json(said)::VARCHAR) + 2) - 2 * count(DISTINCT kind) AS size FROM d JOIN p ON p.conv_id = d.conv_id AND gone > d GROUP BY ALL),
  x AS (SELECT DISTINCT ON (d.conv_id, d.d, t) d.conv_id, d.d, CASE WHEN length(said) <= 800 THEN said ELSE rtrim(substring(said, 1, 800)) || '…' END AS t, CASE kind WHEN 'constraints' THEN 1 WHEN 'key_decisions' THEN 2 ELSE 3 END AS o, -age AS age
    FROM d JOIN p ON p.conv_id = d.conv_id AND gone > d AND kind IN ('constraints', 'key_decisions', 'next_steps') ORDER BY d.conv_id, d.d, t, o, -age),
  y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, d ORDER BY o DESC, age DESC) AS back FROM x QUALIFY back <= 20),
  z AS (SELECT conv_id, d, sum(strlen(to_json(t)::VARCHAR) + 2) - 2 AS size FROM y GROUP BY ALL),
  cut AS (SELECT d.conv_id, coalesce(min(d.d) FILTER (WHERE {len(_EMPTY)} + coalesce(own.size, 0) + coalesce(z.size, 0) <= {_BUDGET}), max(d.d)) AS d FROM d LEFT JOIN own ON own.conv_id = d.conv_id AND own.d = d.d LEFT JOIN z ON z.conv_id = d.conv_id AND z.d = d.d GROUP BY d.conv_id),
  kept AS (SELECT p.conv_id, kind, CAST(row_number() OVER (PARTITION BY p.conv_id, kind ORDER BY age DESC) AS INTEGER) AS place, to_json(said)::VARCHAR AS item FROM p JOIN cut ON cut.conv_id = p.conv_id AND gone > cut.d)
  SELECT * FROM kept UNION ALL SELECT y.conv_id, 'critical_context', CAST(row_number() OVER (PARTITION BY y.conv_id ORDER BY back DESC) AS INTEGER), to_json(t)::VARCHAR FROM y JOIN cut ON cut.conv_id = y.conv_id AND cut.d = y.d"""


@query("d20_checkpoint", _CHECKPOINT)
def checkpoint(s: Store) -> DataFrame:
    return answers.checkpoint_items(s.raw("conversations").select("conv_id", "turn", "role", F.expr(_LEAD).alias("text")), _BUDGET)


_LOGS = "SELECT event_type AS path, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_no, props AS text FROM events"


@query(
    "d05_log_coverage",
    f"""SELECT path, CAST(count(*) AS BIGINT) AS total_lines, CAST(least(count(*), 400) AS BIGINT) AS indexed_lines, CAST(sum(length(text)) AS BIGINT) AS total_bytes, CAST(least(sum(length(text)), 9000) AS BIGINT) AS indexed_bytes,
  concat_ws(',', CASE WHEN sum(length(text)) > 9000 THEN 'byte_cap' END, CASE WHEN count(*) > 400 THEN 'log_sample' END) AS reasons, sum(length(text)) > 9000 OR count(*) > 400 AS indexed_partial FROM ({_LOGS}) GROUP BY path""",
)
def coverage(s: Store) -> DataFrame:
    place = F.row_number().over(W.partitionBy("event_type").orderBy("event_id"))
    lines = s.raw("events").select(F.col("event_type").alias("path"), place.alias("line_no"), F.col("props").alias("text"))
    sizes = lines.groupBy("path").agg(F.sum(F.length("text")).alias("total_bytes"))
    return answers.log_coverage(lines, sizes, 400, 9000).withColumn("reasons", F.array_join("partial_reasons", ",")).drop("partial_reasons")


_SECTIONS = """SELECT conv_id AS doc_id, turn + 1 AS position, CASE WHEN turn % 2 = 0 THEN 'x' || turn END AS id, CASE WHEN turn % 3 = 0 THEN '  ' ELSE substring(text, 1, 24) END AS title,
  CASE WHEN turn % 4 <> 1 THEN role END AS summary, turn % 5 = 2 AS anchored, role FROM conversations"""
_NORMAL = f"""SELECT doc_id, position, coalesce(id, 's' || position) AS id, coalesce(nullif(trim(title), ''), 'Section ' || position) AS title, coalesce(summary, '') AS summary, [role, 'Turn'] AS terms,
  CASE WHEN anchored THEN 'at ' || position ELSE coalesce(nullif(trim(title), ''), 'Section ' || position) END AS anchor FROM ({_SECTIONS})"""


def _sections(s: Store) -> DataFrame:
    rows = s.spark.sql(_SECTIONS.replace("FROM conversations", "FROM {c}"), c=s.raw("conversations"))
    return answers.normal_sections(rows.withColumn("key_terms", F.array("role", F.lit(" Turn "), F.lit(" "))).withColumn("anchor", F.when(F.col("anchored"), F.concat(F.lit("at "), "position"))))


@query("x28_normal_sections", f"SELECT doc_id, position, id, title, summary, array_to_string(terms, ',') AS terms, anchor FROM ({_NORMAL})")
def normal_sections(s: Store) -> DataFrame:
    return _sections(s).select("doc_id", "position", "id", "title", "summary", F.array_join("key_terms", ",").alias("terms"), F.col("anchor.value").alias("anchor"))


@query(
    "x27_retrieval_extra",
    rf"""WITH n AS ({_NORMAL}), g AS (SELECT doc_id, count(*) AS n, flatten(list(list_append(terms, title) ORDER BY position)) AS t, list(substring(array_to_string(list_filter([id, anchor, title, summary], lambda p: p <> ''), ' '), 1, 220) ORDER BY position)[1:4] AS bits FROM n GROUP BY doc_id)
  SELECT doc_id, 'indexed_coverage: ' || n || '/' || (n + 1) || ' turns; partial=true; chunk_count=1' || chr(10) || 'retrieval_terms: ' || array_to_string(list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i)[1:5], '; ')
    || chr(10) || 'section_map: ' || array_to_string(bits, ' | ') || CASE WHEN n > 4 THEN ' | ... ' || (n - 4) || ' more sections' ELSE '' END AS extra FROM g""",
)
def extra(s: Store) -> DataFrame:
    n = s.raw("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("indexed_units"))
    known = n.select("doc_id", F.lit("turns").alias("unit"), (F.col("indexed_units") + 1).alias("total_units"), "indexed_units", F.lit(True).alias("indexed_partial"), F.lit(1).alias("chunk_count"))
    return answers.retrieval_extra(_sections(s), known, 5, 4)


_MEMBERS = r"SELECT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS archive, url || CASE page_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.json' WHEN 2 THEN '/README' WHEN 3 THEN '.csv' ELSE '' END AS member, length(html) AS size FROM {t}"
_RANK = "CASE regexp_extract(name, '.(\\.[^.]*)$', 1) " + " ".join(f"WHEN '{e}' THEN {n}" for e, n in answers.MEMBER_PRIORITY.items()) + " ELSE 9 END - CASE WHEN " + " OR ".join(f"contains(name, '{n}')" for n in answers.MEMBER_NAMES) + " THEN 2 ELSE 0 END"


@query(
    "d15_ranked_members",
    f"""WITH m AS (SELECT *, lower(string_split(member, '/')[-1]) AS name FROM ({_MEMBERS.format(t="pages")})),
  r AS (SELECT archive, member, CAST(size AS INTEGER) AS size, CAST(row_number() OVER (PARTITION BY archive ORDER BY {_RANK}, size, member) AS INTEGER) AS place, max(size) OVER (PARTITION BY archive) AS most FROM m)
  SELECT archive, member, size, place FROM r WHERE place <= CASE WHEN most < 4096 THEN 16 ELSE 8 END""",
)
def members(s: Store) -> DataFrame:
    return answers.ranked_members(s.spark.sql(_MEMBERS.replace("{t}", "{pages}"), pages=s.raw("pages")))


_FILE_SECTIONS = "SELECT doc_id AS file_id, 1 AS position, 's1' AS id, CASE WHEN doc_id % 4 = 0 THEN 'Page 7' ELSE lang END AS title, source AS summary FROM {t}"


@query(
    "vs07_semantic_inputs",
    with_store(
        f"""SELECT CAST(entry_id AS STRING) AS record_id, entry_id, CAST(NULL AS STRING) AS section_id, display_name || CASE WHEN trim(summary) <> '' THEN chr(10) || trim(summary) ELSE '' END AS text FROM v
    UNION ALL SELECT entry_id || '#section:s1', entry_id, 's1', CASE WHEN summary <> '' THEN 'summary: ' || summary || chr(10) || chr(10) ELSE '' END || 'section: ' || catalog_id || ' ' || folder_id || ' key' FROM v WHERE file_id % 4 <> 0""",
        "entries", "files",
    ).replace("\nSELECT", f""", v AS (SELECT e.*, f.summary FROM entries e JOIN files f ON e.file_id = f.file_id WHERE e.deleted_at IS NULL AND f.deleted_at IS NULL AND e.lifecycle IN ({", ".join(f"'{a}'" for a in ACTIVE)}) AND f.ingest_status = 'done')\nSELECT""", 1),
)
def semantic_inputs(s: Store) -> DataFrame:
    parts = s.spark.sql(_FILE_SECTIONS.replace("{t}", "{d}"), d=s.raw("documents").drop("text")).withColumn("key_terms", F.array(F.lit("key")))
    return answers.semantic_inputs(s.entries, s.files.drop("body"), parts, tuple(ACTIVE))


@query("vs09_same_index", "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey % 3 = 1 AND s_nationkey % 4 IN (0, 1) AND s_acctbal > 0")
def same_index(s: Store) -> DataFrame:
    """Suppliers stand for recorded indexes."""
    n = F.col("s_nationkey")
    manifest = s.raw("supplier").select(F.col("s_suppkey").alias("id"), (n % 3).alias("version"), F.when(n % 4 == 1, "here").when(n % 4 != 0, "there").alias("provider"), F.when(F.col("s_acctbal") > 0, "m").otherwise("n").alias("model"), F.lit(64).alias("dimensions"))
    return answers.same_index(manifest, 1, "here", "m", 64).select("id")


_RELATIONS = "SELECT a, b, observation_count, CASE WHEN (a + b) % 3 = 0 THEN (a + b) % 2 = 0 END AS vetted, 1 + (a + b) % 4 AS vetted_observation_count, TIMESTAMP '2023-06-01' + INTERVAL 1 DAY * CAST((a * b) % 300 AS INT) AS vetted_at FROM edges"


def _relations(s: Store) -> DataFrame:
    e = s.edges
    at = F.timestamp_add("DAY", ((F.col("a") * F.col("b")) % 300).cast("int"), F.lit("2023-06-01").cast("timestamp_ntz"))
    return e.withColumn("vetted", F.when((F.col("a") + F.col("b")) % 3 == 0, (F.col("a") + F.col("b")) % 2 == 0)).withColumn("vetted_observation_count", 1 + (F.col("a") + F.col("b")) % 4).withColumn("vetted_at", at)


@query("g09_needs_vetting", with_store(f"SELECT a, b, vetted IS NULL OR vetted_at < TIMESTAMP '{NOW}' - INTERVAL 180 DAY OR observation_count >= 2 * vetted_observation_count + 5 AS due FROM ({_RELATIONS})", "edges"))
def due(s: Store) -> DataFrame:
    return _relations(s).select("a", "b", graph.needs_vetting(NOW).alias("due"))


_STRENGTH = {"auto": 1, "review": 2, "user": 3}
_SOURCE = "CASE {c} % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'review' WHEN 2 THEN 'user' ELSE 'unknown' END"


@query("g08_stronger_source", "SELECT l_orderkey AS id, l_linenumber AS n, " + " >= ".join(f"CASE ({_SOURCE.format(c=c)}) WHEN 'auto' THEN 1 WHEN 'review' THEN 2 WHEN 'user' THEN 3 ELSE 0 END" for c in ("l_partkey", "l_suppkey")) + " AS replaces FROM lineitem")
def stronger(s: Store) -> DataFrame:
    new, old = (F.expr(_SOURCE.format(c=c)) for c in ("l_partkey", "l_suppkey"))
    return s.raw("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), graph.stronger(new, old, _STRENGTH).alias("replaces"))


@query("m19_supersede", with_store("SELECT id, superseded OR id = 7 AS superseded, invalidated OR note = '1-URGENT' AS invalidated FROM journal", "journal"))
def superseded(s: Store) -> DataFrame:
    notes = s.journal.select("id", "note", F.when(F.col("superseded"), -1).cast("long").alias("superseded_by_id"), F.when(F.col("invalidated"), F.lit(NOW).cast("timestamp_ntz")).alias("invalidated_at"))
    rows = repository.invalidate(repository.supersede(notes, 7, 8), notes.filter("note = '1-URGENT'").select("id"), NOW)
    return rows.select("id", F.col("superseded_by_id").isNotNull().alias("superseded"), F.col("invalidated_at").isNotNull().alias("invalidated"))


_STAMPED = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' x' WHEN 1 THEN '1.2.3.4 - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] y' WHEN 2 THEN strftime(ts, '%b %d %H:%M:%S') || ' host z' ELSE 'no time' END"


@query("x17_any_time_stamp", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN date_trunc('second', ts) END AS at FROM events")
def stamps(s: Store) -> DataFrame:
    ts, kind = F.col("ts"), F.col("event_id") % 4
    line = F.when(kind == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" x"))).when(kind == 1, F.concat(F.lit("1.2.3.4 - ["), F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] y")))
    line = line.when(kind == 2, F.concat(F.date_format(ts, "MMM dd HH:mm:ss"), F.lit(" host z"))).otherwise("no time")
    # a system log has no year of its own: it is read as of the year that the table is from
    return s.raw("events").select("event_id", F.coalesce(*[F.when(F.year(ts) == y, any_time_stamp(line, y)) for y in (2023, 2024, 2025)]).alias("at"))


@query(
    "x20_first_page",
    f"""WITH p AS (SELECT conv_id, turn, {_plain_sql("text")} AS text FROM conversations), q AS (SELECT conv_id, {_plain_sql("arg_max(substring(text, 3, 50), turn)")} AS quote FROM conversations GROUP BY conv_id HAVING trim(arg_max(substring(text, 3, 50), turn)) <> '')
  SELECT q.conv_id AS quote_id, min(p.turn) AS page FROM q LEFT JOIN p ON p.conv_id = q.conv_id AND quote <> '' AND contains(p.text, q.quote) GROUP BY q.conv_id""",
)
def first_pages(s: Store) -> DataFrame:
    pages = s.raw("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    quotes = pages.groupBy("doc_id").agg(F.max_by(F.substring("text", 3, 50), "page").alias("quote")).filter("trim(quote) <> ''").withColumn("quote_id", F.col("doc_id"))
    return documents.first_page(pages, quotes)


_TABLE = "CASE p_partkey % 5 WHEN 0 THEN 'a,b' || chr(10) || p_partkey || ',2' WHEN 1 THEN 'a|b;c' || chr(10) || '1|2;3' || chr(10) WHEN 2 THEN 'a;b;c' || chr(10) || '1;2;3' WHEN 3 THEN 'a,b' || chr(10) || '1,2,3' ELSE p_name END"


@query("x39_delimiter", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN ',' WHEN 1 THEN '|' WHEN 2 THEN ';' END AS mark FROM part")
def delimiters(s: Store) -> DataFrame:
    return s.raw("part").select(F.col("p_partkey").alias("id"), documents.delimiter(F.expr(_TABLE)).alias("mark"))


@query("j10_tags_of_entries", with_store("SELECT entry_id, name AS tag_id, upper(name) AS name, facet FROM entry_tags WHERE name <> 'medium' AND entry_id IN (SELECT entry_id FROM entries WHERE lifecycle = 'demoted')", "entry_tags", "entries"))
def tags_of(s: Store) -> DataFrame:
    bridge = s.entry_tags.select("entry_id", F.col("name").alias("tag_id"), F.lit("auto").alias("source"))
    tags = s.entry_tags.select(F.col("name").alias("id"), "facet").distinct().withColumn("name", F.upper("id")).withColumn("alias_of", F.when(F.col("id") == "medium", "long"))
    ids = s.entries.filter("lifecycle = 'demoted'").select(F.col("entry_id").alias("id"))
    return repository.tags_of(bridge, tags, ids).select("entry_id", "tag_id", "name", "facet")
