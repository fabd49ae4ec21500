"""Parts of documents, sets of results, snapshots, counts of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.binding import Store, with_store
from quern.functions.text import recall_weight
from quern.operators import documents as parts
from quern.operators import graph, lifecycle, repository, store
from quern.queries import query
from quern.sources import readers


@query("d01_lines", "SELECT doc_id, CAST(i AS BIGINT) AS line_no, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i) WHERE length(text) > 0")
def lines(s: Store) -> DataFrame:
    return parts.lines(s.raw("documents")).withColumn("line_no", F.col("line_no").cast("long"))


@query("d02_line_range", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents")
def line_range(s: Store) -> DataFrame:
    return s.raw("documents").select("doc_id", parts.line_range(F.col("text"), 2, 4).alias("part"))


@query("d09_page_window", "SELECT o_orderkey AS id, least(greatest(o_orderkey % 9 - 2, 1), 5) AS first, least(greatest(CASE WHEN o_orderkey % 4 = 0 THEN least(greatest(o_orderkey % 9 - 2, 1), 5) ELSE o_orderkey % 11 END, least(greatest(o_orderkey % 9 - 2, 1), 5)), 5) AS last FROM orders")
def page_window(s: Store) -> DataFrame:
    first, last = parts.clamp(F.col("o_orderkey") % 9 - 2, F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 11), F.lit(5).cast("long"))
    return s.raw("orders").select(F.col("o_orderkey").alias("id"), first.alias("first"), last.alias("last"))


@query("d18_digest", "SELECT conv_id AS doc_id, string_agg('- ' || title, chr(10) ORDER BY turn) AS digest FROM (SELECT *, sum(length(title) + 3) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT conv_id, turn, substring(text, 1, 40) AS title FROM conversations)) WHERE n <= 150 GROUP BY conv_id")
def digest(s: Store) -> DataFrame:
    rows = s.raw("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), F.substring("text", 1, 40).alias("title"))
    return parts.sections_digest(rows, 150)


@query("x18_citations", """SELECT conv_id AS id, CAST(turn AS VARCHAR) AS marker, CAST(conv_id * 10 + turn AS VARCHAR) AS entry_id, role || ' "x"' AS quote, CASE WHEN turn % 2 = 0 THEN CAST(turn + 1 AS VARCHAR) END AS page, NULL::VARCHAR AS section_id, CASE WHEN turn % 3 = 0 THEN 'because' END AS reason FROM conversations""")
def citations(s: Store) -> DataFrame:
    note = F.concat(
        F.lit("[^"), "turn", F.lit("]: entry_id="), (F.col("conv_id") * 10 + F.col("turn")).cast("string"), F.lit(', quote="'), "role", F.lit(' \\"x\\""'),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit(", page="), (F.col("turn") + 1).cast("string"))).otherwise(""), F.when(F.col("turn") % 3 == 0, " | because").otherwise(""),
    )
    answers = s.raw("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.concat(F.lit("Text[^0].\n"), F.array_join(F.sort_array(F.collect_list(note)), "\n")).alias("text"))
    return parts.citations(answers)


@query("x19_quotes", r"SELECT doc_id, regexp_replace(substring(text, 5, 60), '[\s\p{P}\p{Z}\p{C}]', '', 'g') <> '' AS found FROM documents")
def quotes(s: Store) -> DataFrame:
    return s.raw("documents").select("doc_id", parts.quote_in(F.col("text"), F.upper(F.substring("text", 5, 60))).alias("found"))


@query("x22_chunks", """WITH RECURSIVE l AS (SELECT doc_id, CAST(i AS INTEGER) AS i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i) WHERE text <> ''),
  r AS (SELECT doc_id, i, 0 AS chunk, length(line) + 1 AS size FROM l WHERE i = 1 UNION ALL
    SELECT l.doc_id, l.i, CASE WHEN r.size + length(l.line) + 1 > 400 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.size + length(l.line) + 1 > 400 THEN length(l.line) + 1 ELSE r.size + length(l.line) + 1 END
    FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
  SELECT doc_id, chunk, min(i) AS first_line, max(i) AS last_line, string_agg(line, chr(10) ORDER BY i) AS text FROM r JOIN l USING (doc_id, i) GROUP BY doc_id, chunk""")  # fmt: skip
def chunks(s: Store) -> DataFrame:
    return parts.chunks(s.raw("documents"), 400)


@query("x23_sections", """SELECT doc_id, lang AS title, 1 AS depth, 1 AS first_line, CAST(len(string_split(text, chr(10))) + 3 AS INTEGER) AS last_line FROM documents
  UNION ALL SELECT doc_id, 'tail', 2, CAST(len(string_split(text, chr(10))) + 2 AS INTEGER), CAST(len(string_split(text, chr(10))) + 3 AS INTEGER) FROM documents""")  # fmt: skip
def sections(s: Store) -> DataFrame:
    docs = s.raw("documents").select("doc_id", F.concat(F.lit("# "), "lang", F.lit("\n"), F.replace("text", F.lit("#"), F.lit("")), F.lit("\n## tail ##\nend")).alias("text"))
    return parts.sections(docs)


@query("x26_text_window", "SELECT doc_id, substring(text, 101, 200) AS part, CASE WHEN length(text) > 300 THEN 300 END AS next_offset FROM documents")
def text_window(s: Store) -> DataFrame:
    part, after = parts.window_of(F.col("text"), 100, 200)
    return s.raw("documents").select("doc_id", part.alias("part"), after.alias("next_offset"))


@query("x46_chart", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type ORDER BY event_type LIMIT 1000")
def chart(s: Store) -> DataFrame:
    return parts.chart(s.raw("events"), "event_type", "value", "mean").select("event_type", F.round("mean", 6).alias("mean"))


@query("x47_token_bound", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def token_bound(s: Store) -> DataFrame:
    return s.raw("documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@query("f24_glob", "SELECT page_id FROM pages WHERE regexp_full_match(url, 'http://.*/.*/.*ref=.*', 's')")
def glob(s: Store) -> DataFrame:
    return s.raw("pages").filter(parts.matches_glob(F.col("url"), "http://*/**/*ref=*")).select("page_id")


_PATHS = "p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


@query("t09_directory", f"WITH {_PATHS} SELECT array_to_string(string_split(path, '/')[1:i], '/') AS path, CAST(i AS INTEGER) AS depth, string_split(path, '/')[i] AS name, CAST(count(*) AS BIGINT) AS files FROM p, unnest(range(1, least(len(string_split(path, '/')), 4) + 1)) t(i) GROUP BY ALL")
def directory(s: Store) -> DataFrame:
    paths = s.raw("pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    return parts.directory_lines(paths)


@query("f25_listable", f"WITH {_PATHS} SELECT path, NOT regexp_matches(path, '^(/|[A-Za-z]:)|(^|/)\\.\\.(/|$)|(^|/)(\\.git|__pycache__|node_modules|__MACOSX|\\.DS_Store)(/|$)|\\.(pyc|class|o)$') AS ok FROM p")
def listable(s: Store) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return s.raw("pages").select(path.alias("path")).withColumn("ok", parts.listable(F.col("path")))


@query("x03_recall_weights", f"SELECT doc_id, {recall_weight('Licensed')} * CAST(contains(lower(text), 'licensed') AS INT) + {recall_weight('4.0')} * CAST(contains(text, '4.0') AS INT) AS weight FROM documents".replace("SELECT doc_id, ", "SELECT doc_id, round(CAST(").replace(" AS weight", " AS DOUBLE), 6) AS weight"))
def recall_weights(s: Store) -> DataFrame:
    total = F.lit(0.0)
    for t in ("Licensed", "4.0"):
        total = total + F.lit(recall_weight(t)) * F.contains(F.lower("text"), F.lit(t.lower())).cast("int")
    return s.raw("documents").select("doc_id", F.round(total, 6).alias("weight"))


@query("h02_resolve_tags", with_store("SELECT DISTINCT upper(name) AS name, CASE name WHEN 'medium' THEN 'long' WHEN 'zzz' THEN NULL ELSE name END AS tag_id FROM (SELECT name FROM entry_tags UNION ALL SELECT 'zzz')", "entry_tags"))
def resolve(s: Store) -> DataFrame:
    names = s.entry_tags.select("name").distinct()
    tags = names.filter("name <> 'toxic'").select(F.col("name").alias("id"), "name", F.when(F.col("name") == "medium", "long").alias("alias_of"))
    aliases = names.filter("name = 'toxic'").select(F.col("name").alias("from_name"), F.col("name").alias("tag_id"))
    wanted = names.select(F.upper("name").alias("name")).union(names.select(F.lit("ZZZ")).distinct())
    return store.resolve_tags(wanted, tags, aliases)


@query("j14_merge_snapshots", with_store("SELECT entry_id, CASE WHEN entry_id % 2 = 0 AND (entry_id % 3 <> 0 OR entry_id % 4 = 0) THEN 'remote' ELSE 'local' END AS side FROM entries WHERE entry_id % 2 = 0 OR entry_id % 3 = 0", "entries"))
def snapshots(s: Store) -> DataFrame:
    """Remote has the even ids, local those that 3 divides; of those on both sides, remote is newer where 4 divides."""
    e = s.entries.select("entry_id", "updated_at", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    newer = F.when(F.col("entry_id") % 4 == 0, F.timestamp_add("DAY", F.lit(1), "updated_at")).otherwise(F.col("updated_at"))
    remote = e.filter("entry_id % 2 = 0").withColumn("updated_at", newer).withColumn("side", F.lit("remote"))
    local = e.filter("entry_id % 3 = 0").withColumn("side", F.lit("local"))
    return store.merge_snapshots(remote, local, "entry_id").select("entry_id", "side")


@query("m06_tag_triples", with_store("SELECT x.name AS t1, y.name AS t2, z.name AS t3, CAST(count(DISTINCT x.entry_id) AS BIGINT) AS members FROM entry_tags x JOIN entry_tags y ON x.entry_id = y.entry_id AND x.name < y.name JOIN entry_tags z ON x.entry_id = z.entry_id AND y.name < z.name GROUP BY ALL HAVING count(DISTINCT x.entry_id) >= 10", "entry_tags"))
def triples(s: Store) -> DataFrame:
    return graph.tag_triples(s.entry_tags, 10)


@query("m13_due_kinds", "SELECT event_type AS kind, max(ts) AS last_at FROM events GROUP BY event_type HAVING epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts))) >= 86400 + 60 * length(event_type)")
def due_kinds(s: Store) -> DataFrame:
    e = s.raw("events")
    kinds = e.select(F.col("event_type").alias("kind")).distinct().withColumn("every_seconds", 86400 + 60 * F.length("kind"))
    return lifecycle.due(kinds, e.select(F.col("event_type").alias("kind"), F.col("ts").alias("at")), "2024-02-01 00:00:00")


@query("a02_recounted_tags", with_store("SELECT t.name, CAST(count(DISTINCT e.entry_id) AS BIGINT) AS doc_count FROM (SELECT DISTINCT name FROM entry_tags UNION ALL SELECT 'unused') t LEFT JOIN entry_tags e ON e.name = t.name GROUP BY t.name", "entry_tags"))
def recounted(s: Store) -> DataFrame:
    names = s.entry_tags.select("name").distinct()
    return lifecycle.usage_counts(names.union(names.select(F.lit("unused")).distinct()), s.entry_tags)


@query("a07_task_counts", with_store("SELECT status, CAST(count(*) AS BIGINT) AS n FROM tasks GROUP BY status", "tasks"))
def task_counts(s: Store) -> DataFrame:
    return s.tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("a22_run_totals", "SELECT l_returnflag AS run, CAST(count(*) AS BIGINT) AS answers, round(avg(CAST(l_discount > 0.05 AS DOUBLE)), 6) AS hit_rate, round(avg(l_linenumber) FILTER (WHERE l_tax > 0), 6) AS avg_first_rank, CAST(sum(l_quantity) AS DOUBLE) AS usage FROM lineitem GROUP BY l_returnflag")
def run_totals(s: Store) -> DataFrame:
    return s.raw("lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(
        F.count(F.lit(1)).alias("answers"), F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("hit_rate"),
        F.round(F.avg(F.when(F.col("l_tax") > 0, F.col("l_linenumber"))), 6).alias("avg_first_rank"), F.sum("l_quantity").alias("usage"),
    )


@query("a23_pairwise_wins", "SELECT p_brand AS brand, CAST(count(*) FILTER (WHERE p_size > 25) AS BIGINT) AS wins, CAST(count(*) FILTER (WHERE p_size < 25) AS BIGINT) AS losses, CAST(count(*) FILTER (WHERE p_size = 25) AS BIGINT) AS ties FROM part GROUP BY p_brand")
def wins(s: Store) -> DataFrame:
    return s.raw("part").groupBy(F.col("p_brand").alias("brand")).agg(F.count_if(F.col("p_size") > 25).alias("wins"), F.count_if(F.col("p_size") < 25).alias("losses"), F.count_if(F.col("p_size") == 25).alias("ties"))


@query("set02_ordered_union", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s, p, event_id) AS INTEGER) AS place FROM (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS s, CASE WHEN event_type = 'purchase' THEN event_id ELSE -event_id END AS p FROM events WHERE event_type IN ('purchase', 'view', 'click')) QUALIFY place <= 20")
def ordered_union(s: Store) -> DataFrame:
    e = s.raw("events")
    first = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("place"))
    rest = e.filter("event_type IN ('purchase', 'view', 'click')").select("user_id", "event_id", (-F.col("event_id")).alias("place"))
    return store.ordered_union([first, rest], ["user_id", "event_id"], 20, ["user_id"])


@query("m09_transition", with_store("SELECT entry_id, CASE WHEN lifecycle = 'active' AND entry_id % 3 = 0 THEN 'demoted' ELSE lifecycle END AS lifecycle FROM entries", "entries"))
def transition(s: Store) -> DataFrame:
    return lifecycle.transition(s.entries, s.entries.filter("entry_id % 3 = 0").select("entry_id"), "active", "demoted").select("entry_id", "lifecycle")


@query("j17_enqueue", with_store("SELECT id FROM tasks UNION ALL SELECT min(p_partkey) + 1000000000 FROM part WHERE p_partkey % 1000 NOT IN (SELECT dedup_key FROM tasks WHERE status IN ('pending', 'running')) GROUP BY p_partkey % 1000", "tasks"))
def enqueue(s: Store) -> DataFrame:
    new = s.raw("part").select((F.col("p_partkey") + 1_000_000_000).alias("id"), (F.col("p_partkey") % 1000).alias("dedup_key"), F.lit("pending").alias("status"))
    return lifecycle.enqueue(s.tasks.select("id", "dedup_key", "status"), new).select("id")


@query("t10_restructure", with_store("""SELECT id, CASE WHEN id LIKE 'c%' AND CAST(substring(id, 2) AS INT) % 4 = 0 THEN 'world' WHEN parent_id = 'n3' THEN 'r1' ELSE parent_id END AS parent_id,
  CASE WHEN id LIKE 'r%' THEN 'region ' || id ELSE name END AS name, deleted OR id = 'n3' AS deleted FROM folders""", "folders"))  # fmt: skip
def restructured(s: Store) -> DataFrame:
    f = s.folders
    ops = f.filter("id LIKE 'c%' AND CAST(substring(id, 2) AS INT) % 4 = 0").select(F.lit(1).alias("seq"), F.lit("move").alias("op"), "id", F.lit("world").alias("target"))
    ops = ops.union(f.filter("id LIKE 'r%'").select(F.lit(2), F.lit("rename"), "id", F.concat(F.lit("region "), "id")))
    ops = ops.union(f.filter("id = 'n3'").select(F.lit(3), F.lit("delete"), "id", F.lit("r1")))
    entries = f.select(F.col("id").alias("entry_id"), F.col("parent_id").alias("catalog_id"))
    return store.restructure(f, entries, ops)[0]


#: A format whose logs are told by name before their general type, one by types, and one for the rest.
_FORMATS = (
    readers.Format("text", mimes=("text/plain",), mime_starts=("text/",), extensions=(".txt", ".md")), readers.Format("log", extensions=(".log",), patterns=(r"\.log[.-]\d+$",), by_name_first=True),
    readers.Format("table", mimes=("text/csv",), extensions=(".csv", ".tsv")), readers.Format("backup", patterns=(r"~$",)), readers.Format("other", fallback=True),
)
_NAMED = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'text/x-note' WHEN 3 THEN 'application/pdf' END AS mime, CASE doc_id % 6 WHEN 0 THEN '.LOG' WHEN 1 THEN 'csv' WHEN 2 THEN '.md' WHEN 3 THEN '' END AS ext,
  concat('File', doc_id, CASE doc_id % 7 WHEN 0 THEN '.log.3' WHEN 1 THEN '.old~' ELSE '' END) AS name FROM {t}"""


@query(
    "src20_formats",
    f"""WITH n AS ({_NAMED.format(t="documents")}) SELECT doc_id, CASE WHEN lower(ext) = '.log' THEN 'log' WHEN name LIKE '%.log.3' THEN 'log' WHEN mime = 'text/plain' THEN 'text' WHEN mime = 'text/csv' THEN 'table' WHEN mime LIKE 'text/%' THEN 'text'
  WHEN ext = '.md' THEN 'text' WHEN ext = 'csv' THEN 'table' WHEN name LIKE '%~' THEN 'backup' ELSE 'other' END AS format FROM n""",
)
def formats(s: Store) -> DataFrame:
    rows = s.spark.sql(_NAMED.format(t="{t}"), t=s.raw("documents"))
    return rows.select("doc_id", readers.resolve_format(F.col("mime"), F.col("ext"), F.col("name"), _FORMATS).alias("format"))


@query("j03_vet_candidates", with_store("SELECT a || '-' || b AS id, observation_count FROM edges WHERE (a + b) % 3 <> 0 AND observation_count >= 2 AND a NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) AND b NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) ORDER BY observation_count DESC, id LIMIT 50", "edges"))
def vet_candidates(s: Store) -> DataFrame:
    """Relations of suppliers that no one has judged; suppliers of one nation are deleted."""
    relations = s.edges.select(F.concat_ws("-", "a", "b").alias("id"), F.col("a").alias("entry_a_id"), F.col("b").alias("entry_b_id"), "observation_count", F.when((F.col("a") + F.col("b")) % 3 == 0, F.lit(True)).alias("vetted"))
    entries = s.raw("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") == 3, F.lit("gone")).alias("deleted_at"))
    return repository.vet_candidates(relations, entries, 2, 50).select("id", "observation_count")


@query("a26_oldest", "SELECT min(ts) AS oldest FROM events")
def oldest(s: Store) -> DataFrame:
    return repository.oldest(s.raw("events"), "ts")
