"""Trees, graphs, mining, vectors, recall, evaluation, maintenance, logs, ad-hoc SQL and windows over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.binding import NOW, STORE_SQL, Store, with_store
from quern.functions.text import level, time_stamp
from quern.operators import evaluation, graph, lifecycle, logs, retrieval, search_index, trees, vectors
from quern.operators.components import connected_components
from quern.plans.lineage import shuffles_freed, written
from quern.queries import query
from quern.sources.adhoc import run_sql
from quern.streaming import windows

_TREE = f"""WITH RECURSIVE folders AS ({STORE_SQL["folders"]}),
  down AS (SELECT id AS root, id, 0 AS depth FROM folders WHERE NOT deleted AND id LIKE 'r%'
    UNION ALL SELECT d.root, f.id, d.depth + 1 FROM down d JOIN folders f ON f.parent_id = d.id WHERE NOT f.deleted),
  up AS (SELECT id, id AS ancestor, 0 AS distance FROM folders
    UNION ALL SELECT u.id, f.parent_id, u.distance + 1 FROM up u JOIN folders f ON f.id = u.ancestor WHERE f.parent_id IS NOT NULL)
"""


def _regions(s: Store) -> DataFrame:
    return s.folders.filter("id LIKE 'r%'").select("id")


@query("t01_subtree", _TREE + "SELECT root, id, depth FROM down")
def subtree(s: Store) -> DataFrame:
    return trees.subtree(s.folders, _regions(s))


@query("t03_path", _TREE + "SELECT u.id, string_agg(f.name, '/' ORDER BY u.distance DESC) AS path FROM up u JOIN folders f ON f.id = u.ancestor GROUP BY u.id")
def paths(s: Store) -> DataFrame:
    return trees.paths(s.folders, s.folders.select("id"))


@query("t04_ancestors", _TREE + "SELECT id, ancestor, distance FROM up WHERE id LIKE 'c%'")
def ancestors(s: Store) -> DataFrame:
    return trees.ancestors(s.folders, s.folders.filter("id LIKE 'c%'").select("id"))


@query("t05_would_cycle", _TREE + ", moves AS (SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'c' || c_custkey ELSE 'world' END AS parent_id FROM nation JOIN customer ON c_nationkey = n_nationkey) SELECT DISTINCT m.id, m.parent_id, EXISTS (SELECT 1 FROM up u WHERE u.id = m.parent_id AND u.ancestor = m.id) AS cycle FROM moves m")
def would_cycle(s: Store) -> DataFrame:
    moves = s.raw("nation").join(s.raw("customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    moves = moves.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("c"), "c_custkey")).otherwise("world").alias("parent_id")).distinct()
    return trees.would_cycle(s.folders, moves)


@query("t07_nearest_live", _TREE + "SELECT u.id, arg_min(u.ancestor, u.distance) AS ancestor FROM up u JOIN folders f ON f.id = u.ancestor WHERE NOT f.deleted GROUP BY u.id")
def nearest_live(s: Store) -> DataFrame:
    return trees.nearest_live(s.folders, s.folders.select("id"))


@query("t08_listing", with_store("SELECT p.id, CAST(count(c.id) AS BIGINT) AS children FROM folders p LEFT JOIN folders c ON c.parent_id = p.id AND NOT c.deleted WHERE NOT p.deleted AND p.id NOT LIKE 'c%' GROUP BY p.id", "folders"))
def listing(s: Store) -> DataFrame:
    f = s.folders.filter("NOT deleted")
    kids = f.groupBy(F.col("parent_id").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    return f.filter("id NOT LIKE 'c%'").join(kids, F.col("id") == F.col("_p"), "left").select("id", F.coalesce("_n", F.lit(0)).alias("children"))


@query("a05_subtree_status", _TREE + "SELECT d.root, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS done, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS running FROM down d JOIN orders ON d.id = 'c' || o_custkey GROUP BY d.root")
def subtree_status(s: Store) -> DataFrame:
    below = trees.subtree(s.folders, _regions(s)).select("root", "id")
    status = s.raw("orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.col("o_orderstatus").alias("st"))
    counts = status.groupBy("id", "st").agg(F.count(F.lit(1)).alias("n"))
    rows = below.join(counts, "id").groupBy("root").pivot("st", ["F", "O", "P"]).sum("n").na.fill(0)
    return rows.withColumnsRenamed({"F": "done", "O": "pending", "P": "running"})


@query("g01_adjacency", with_store("SELECT a AS src, b AS dst, CAST(greatest(1, observation_count) AS BIGINT) AS weight FROM edges UNION ALL SELECT b, a, CAST(greatest(1, observation_count) AS BIGINT) FROM edges", "edges"))
def adjacency(s: Store) -> DataFrame:
    return graph.adjacency(s.edges)


def walk_sql(edges: str, seeds: str) -> str:
    """Common tables up to `v` (seed, node, visits): six steps of expected walks over `edges` (a, b, observation_count)."""
    steps = "".join(
        f""", m{i} AS (SELECT seed, dst AS node, sum(p * share * 0.85) AS p FROM p{i - 1} JOIN moves ON node = src GROUP BY seed, dst),
  p{i} AS (SELECT seed, node, sum(p) AS p FROM (SELECT * FROM m{i} UNION ALL SELECT s.seed, s.seed, 1 - coalesce((SELECT sum(p) FROM m{i} m WHERE m.seed = s.seed), 0) FROM seeds s) GROUP BY seed, node)"""
        for i in range(1, 7)
    )
    return f""", both_ways AS (SELECT a AS src, b AS dst, observation_count AS w FROM {edges} UNION ALL SELECT b, a, observation_count FROM {edges}),
  moves AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM both_ways),
  seeds AS ({seeds}), p0 AS (SELECT seed, seed AS node, 1.0 AS p FROM seeds){steps},
  v AS (SELECT seed, node, sum(p) AS visits FROM ({" UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, 7))}) WHERE node <> seed GROUP BY seed, node)"""


_WALK = with_store("", "edges").rstrip() + walk_sql("edges", "SELECT DISTINCT src AS seed FROM both_ways WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7)")
_WALK += " SELECT seed, node, round(visits, 6) AS visits, round(visits / sum(visits) OVER (PARTITION BY seed), 6) AS score FROM v"


@query("g02_expected_walk", _WALK)
def walk(s: Store) -> DataFrame:
    """The walks ask for what is near one nation's suppliers."""
    asked = s.raw("supplier").filter("s_nationkey = 7").select(F.col("s_suppkey").alias("id"))
    with shuffles_freed(s.spark):
        edges = written(s.edges)
        seeds = written(graph.adjacency(edges).select(F.col("src").alias("id")).distinct().join(asked, "id", "left_semi"))
    rows = graph.expected_walk(edges, seeds)
    return rows.select("seed", "node", F.round("visits", 6).alias("visits"), F.round("score", 6).alias("score"))


@query(
    "g05_neighbours",
    with_store(
        """, an AS (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7) SELECT anchor, node, weight, place FROM (SELECT src AS anchor, dst AS node, CAST(w AS BIGINT) AS weight, CAST(row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS INTEGER) AS place
      FROM (SELECT a AS src, b AS dst, observation_count AS w FROM edges UNION ALL SELECT b, a, observation_count FROM edges) WHERE src IN (SELECT * FROM an) AND dst NOT IN (SELECT * FROM an)) WHERE place <= 10""",
        "edges",
    ).replace("\n, an", ", an"),
)
def neighbours(s: Store) -> DataFrame:
    """One nation's suppliers are the anchors."""
    anchors = s.raw("supplier").filter("s_nationkey = 7").select(F.col("s_suppkey").alias("id")).withColumn("rank", F.col("id"))
    return graph.neighbours(s.edges, anchors, 10).select("anchor", "node", "weight", "place")


@query(
    "g06_components",
    """WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders), n AS (SELECT k AS node FROM k UNION SELECT k + 1 FROM k),
    f AS (SELECT node, CASE WHEN node - 1 NOT IN (SELECT k FROM k) THEN node END AS first FROM n) SELECT node, max(first) OVER (ORDER BY node) AS component FROM f""",
)
def components(s: Store) -> DataFrame:
    """Every order links its customer to the next one: chains of all lengths, which the SQL finds by their gaps."""
    return connected_components(s.raw("orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1).alias("b")))


@query("m01_cooccurrence", with_store("SELECT x.entry_id AS a, y.entry_id AS b, CAST(count(*) AS BIGINT) AS observation_count FROM mentions x JOIN mentions y ON x.id = y.id AND x.entry_id < y.entry_id GROUP BY ALL HAVING count(*) >= 2", "mentions"))
def cooccurrence(s: Store) -> DataFrame:
    return graph.pair_counts(s.mentions, 2)


_OVERLAP = with_store("", "supplier_tags").rstrip() + """, u AS (SELECT tag_id FROM supplier_tags GROUP BY tag_id HAVING count(*) BETWEEN 2 AND 40),
  p AS (SELECT x.entry_id AS a, y.entry_id AS b FROM supplier_tags x JOIN supplier_tags y ON x.tag_id = y.tag_id AND x.entry_id < y.entry_id WHERE x.tag_id IN (SELECT tag_id FROM u) GROUP BY ALL HAVING count(*) >= 2),
  n AS (SELECT entry_id, count(*) AS n FROM supplier_tags GROUP BY entry_id),
  c AS (SELECT p.a, p.b, (SELECT count(*) FROM supplier_tags x JOIN supplier_tags y ON x.tag_id = y.tag_id WHERE x.entry_id = p.a AND y.entry_id = p.b) AS shared FROM p)
  SELECT a, b, CAST(shared AS INTEGER) AS shared, round(shared / (na.n + nb.n - shared), 6) AS jaccard, CAST(greatest(1, ceil(round(10.0 * shared / (na.n + nb.n - shared), 9))) AS INTEGER) AS weight
  FROM c JOIN n na ON na.entry_id = a JOIN n nb ON nb.entry_id = b WHERE shared / (na.n + nb.n - shared) >= 0.15"""


@query("m03_tag_overlap", _OVERLAP)
def tag_overlap(s: Store) -> DataFrame:
    return graph.tag_overlap(s.supplier_tags, (2, 40), 2, 0.15).withColumn("jaccard", F.round("jaccard", 6))


@query("m05_merge_tags", with_store("SELECT DISTINCT entry_id, CASE name WHEN 'medium' THEN 'long' WHEN 'src1' THEN 'src2' ELSE name END AS name FROM entry_tags", "entry_tags"))
def merge_tags(s: Store) -> DataFrame:
    aliases = s.entry_tags.select("name").distinct().filter("name IN ('medium', 'src1')").select(F.col("name").alias("tag"), F.when(F.col("name") == "medium", "long").otherwise("src2").alias("canonical"))
    return lifecycle.merge_tags(s.entry_tags, aliases)


@query("m07_demote", with_store(f"SELECT entry_id FROM entries WHERE lifecycle = 'active' AND deleted_at IS NULL AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND entry_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 35 DAY)", "entries"))
def demote(s: Store) -> DataFrame:
    seen = s.raw("events").select(F.col("user_id").alias("entry_id"), F.col("ts").alias("at"))
    return lifecycle.demotable(s.entries, seen, NOW, quiet_days=35).select("entry_id")


@query("m08_archive", with_store(f"SELECT entry_id FROM entries WHERE lifecycle = 'demoted' AND deleted_at IS NULL AND updated_at <= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND entry_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 40 DAY)", "entries"))
def archive(s: Store) -> DataFrame:
    seen = s.raw("events").select(F.col("user_id").alias("entry_id"), F.col("ts").alias("at"))
    return lifecycle.archivable(s.entries, seen, NOW, quiet_days=40).select("entry_id")


@query("m10_prune", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 500)")
def prune(s: Store) -> DataFrame:
    return lifecycle.prune(s.raw("events"), "ts", "2024-01-20 00:00:00", "event_id", 500).select("event_id")


@query("m11_orphans", "SELECT p_partkey AS file_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber < 3)")
def orphans(s: Store) -> DataFrame:
    return lifecycle.orphans(s.raw("part").select(F.col("p_partkey").alias("file_id")), s.raw("lineitem").filter("l_returnflag = 'R' AND l_linenumber < 3").select(F.col("l_partkey").alias("file_id")))


@query("m12_recover", with_store("SELECT id, CASE WHEN status = 'running' AND finished_at < TIMESTAMP '1999-01-01' - INTERVAL 10 SECOND THEN CASE WHEN attempts >= 3 THEN 'dead' ELSE 'pending' END ELSE status END AS status FROM tasks", "tasks"))
def recover(s: Store) -> DataFrame:
    return lifecycle.recover(s.tasks.withColumn("lease_until", F.col("finished_at")), "1999-01-01 00:00:00").select("id", "status")


@query(
    "w00_active_keys",
    with_store(
        """SELECT id, CASE WHEN status IN ('pending', 'running') AND row_number() OVER (PARTITION BY dedup_key, status IN ('pending', 'running') ORDER BY
      CASE WHEN status = 'running' AND finished_at >= TIMESTAMP '1999-01-01' THEN 0 WHEN status = 'pending' THEN 1 WHEN attempts < 3 THEN 2 ELSE 3 END, scheduled_at, id) > 1 THEN 'dead' ELSE status END AS status FROM tasks""",
        "tasks",
    ),
)
def active_keys(s: Store) -> DataFrame:
    return lifecycle.active_keys(s.tasks.withColumn("lease_until", F.col("finished_at")), "1999-01-01 00:00:00").select("id", "status")


@query("m14_slots", "SELECT CAST(floor(epoch(ts) / 600) AS BIGINT) AS slot, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def slots(s: Store) -> DataFrame:
    return s.raw("events").groupBy(lifecycle.slot(F.col("ts")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("m17_dedupe_content", with_store("SELECT file_id, first(file_id) OVER (PARTITION BY sha256 ORDER BY ingested_at, file_id) AS seed, CAST(count(*) OVER (PARTITION BY sha256) AS BIGINT) AS copies FROM files WHERE deleted_at IS NULL", "files"))
def dedupe(s: Store) -> DataFrame:
    return lifecycle.dedupe_content(s.files.drop("body"))


_WORK = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'reprocess_file' WHEN 1 THEN 'prune' ELSE 'ingest_file' END AS kind, CASE WHEN o_orderkey % 10 = 3 THEN 'user' END AS scheduled_by,
  CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_custkey % 5 = 0 THEN 'dead' ELSE 'done' END WHEN 'O' THEN CASE WHEN o_custkey % 7 = 0 THEN 'running' ELSE 'pending' END ELSE 'cancelled' END AS status,
  {minus}(o_custkey % 3000 - 60) AS scheduled_at, CASE WHEN o_custkey % 11 > 0 THEN {minus}(o_orderkey % 1900 + o_custkey % 13 - 1) END AS started_at, {minus}(o_orderkey % 1900) AS finished_at FROM {t}"""


@query(
    "a09_throughput",
    f"""WITH k(kind) AS (VALUES ('ingest_file'), ('reprocess_file')), w AS ({_WORK.format(t="orders", minus=f"TIMESTAMP '{NOW}' - to_minutes(1) * ")}),
  s AS (SELECT * REPLACE (CASE WHEN kind = 'reprocess_file' OR scheduled_by <> '' THEN 'reprocess_file' ELSE 'ingest_file' END AS kind) FROM w WHERE kind IN ('ingest_file', 'reprocess_file')),
  active AS (SELECT kind, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running,
    max(greatest(0, date_diff('second', scheduled_at, TIMESTAMP '{NOW}'))) FILTER (WHERE status = 'pending') AS oldest FROM s WHERE status IN ('pending', 'running') GROUP BY kind),
  terminal AS (SELECT kind, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'dead') AS failed,
    avg(greatest(0.0, date_diff('second', started_at, finished_at))) FILTER (WHERE started_at IS NOT NULL) AS seconds FROM s WHERE status IN ('done', 'dead') AND finished_at >= TIMESTAMP '{NOW}' - INTERVAL 720 MINUTE GROUP BY kind)
  SELECT k.kind, coalesce(pending, 0) AS pending, coalesce(running, 0) AS running, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed, CAST(coalesce(oldest, 0) AS BIGINT) AS oldest_pending_age_seconds,
    round(seconds, 6) AS average_duration_seconds, round(done / nullif(done + failed, 0), 6) AS success_rate, round(coalesce(done, 0) / 720, 6) AS completed_per_minute
  FROM k LEFT JOIN active ON active.kind = k.kind LEFT JOIN terminal ON terminal.kind = k.kind""",
)
def throughput(s: Store) -> DataFrame:
    work = s.spark.sql(_WORK.format(t="{t}", minus=f"TIMESTAMP_NTZ '{NOW}' - INTERVAL 1 MINUTE * "), t=s.raw("orders"))
    rows = lifecycle.throughput(work, NOW, 720)
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in rows.dtypes])


@query("x43_backoff", "SELECT event_id, least(2.0 * pow(2.0, user_id % 12 - 1), 300.0) AS seconds FROM events")
def backoff(s: Store) -> DataFrame:
    return s.raw("events").select("event_id", lifecycle.backoff(F.col("user_id") % 12).alias("seconds"))


@query(
    "h06_note_validity",
    with_store(
        """SELECT m.id, m.entry_id, CASE WHEN e.entry_id IS NULL THEN 'missing' WHEN e.deleted_at IS NOT NULL THEN 'entry_deleted' WHEN f.deleted_at IS NOT NULL THEN 'file_deleted'
      WHEN f.ingested_at > TIMESTAMP '2024-01-20' THEN 'stale' ELSE 'ok' END AS state FROM mentions m LEFT JOIN entries e ON m.entry_id = e.entry_id LEFT JOIN files f ON e.file_id = f.file_id""",
        "mentions", "entries", "files",
    ),
)
def note_validity(s: Store) -> DataFrame:
    notes = s.mentions.withColumn("noted_at", F.lit("2024-01-20").cast("timestamp_ntz"))
    return retrieval.note_validity(notes, s.entries, s.files.drop("body"))


def _levelled(text: str, what: str) -> str:
    return f"list_contains(regexp_split_to_array(upper({text}), '[^A-Z]+'), '{what}')"


@query("l01_filter_lines", with_store(f"SELECT line_no, text FROM log_lines WHERE {_levelled('text', 'ERROR')} AND text >= '2024-01-05' AND text < '2024-01-12' AND regexp_matches(text, 'user=1[0-9]')", "log_lines"))
def filter_lines(s: Store) -> DataFrame:
    rows = logs.scope(s.log_lines, level="ERROR", since="2024-01-05 00:00:00", until="2024-01-12 00:00:00")
    return logs.matching(rows, "user=1[0-9]")


@query("l02_count_pattern", with_store("SELECT CAST(count(*) AS BIGINT) AS total_lines, CAST(count(*) FILTER (WHERE regexp_matches(text, 'user=\\d{3}')) AS BIGINT) AS match_count, round(100.0 * count(*) FILTER (WHERE regexp_matches(text, 'user=\\d{3}')) / count(*), 4) AS percent FROM log_lines", "log_lines"))
def count_pattern(s: Store) -> DataFrame:
    return logs.count_pattern(s.log_lines, r"user=\d{3}")


@query("l03_top_values", with_store("SELECT regexp_extract(text, 'user=(\\d+)', 1) AS value, CAST(count(*) AS BIGINT) AS n FROM log_lines GROUP BY 1 ORDER BY n DESC, min(line_no) LIMIT 20", "log_lines"))
def top_values(s: Store) -> DataFrame:
    return logs.top_values(s.log_lines, r"user=(?P<user>\d+)")


@query("l04_time_distribution", with_store("SELECT substring(text, 1, 13) || ':00' AS bucket, CAST(count(*) AS BIGINT) AS n FROM log_lines WHERE regexp_matches(text, 'ERROR') GROUP BY 1 ORDER BY 1 LIMIT 1000", "log_lines"))
def time_distribution(s: Store) -> DataFrame:
    return logs.histogram(s.log_lines, "ERROR")


@query("a13_level_counts", with_store("SELECT regexp_extract(text, ' ([A-Z]+) ', 1) AS level, CAST(count(*) AS BIGINT) AS n, min(CAST(substring(text, 1, 19) AS TIMESTAMP)) AS first_at, max(CAST(substring(text, 1, 19) AS TIMESTAMP)) AS last_at FROM log_lines WHERE NOT contains(text, 'error by') OR contains(text, 'ERROR') GROUP BY 1", "log_lines"))
def level_counts(s: Store) -> DataFrame:
    rows = s.log_lines.select(level(F.col("text")).alias("level"), time_stamp(F.col("text")).alias("ts"))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("w12_context", with_store("SELECT m.line_no AS match_no, string_agg(l.text, chr(10) ORDER BY l.line_no) AS context FROM log_lines m JOIN log_lines l ON l.line_no BETWEEN m.line_no - 2 AND m.line_no + 2 WHERE contains(m.text, 'user=7 ') GROUP BY m.line_no", "log_lines"))
def context(s: Store) -> DataFrame:
    rows = logs.around(s.log_lines, F.contains("text", F.lit("user=7 ")), 2)
    return rows.select("match_no", F.array_join(F.transform("context", lambda t: t["text"]), "\n").alias("context"))


_DOT = "round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
_VS = f"""vs AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, {_DOT} AS score FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % 50 = 0)"""


def _queries(s: Store) -> DataFrame:
    return s.raw("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _records(s: Store) -> DataFrame:
    return s.raw("embeddings").select(F.col("vec_id").alias("entry_id"), F.col("label").alias("section_id"), F.col("embedding").alias("vector"))


@query("vs01_top_k", f"WITH {_VS} SELECT query_id, entry_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS INTEGER) AS rank FROM vs QUALIFY rank <= 10")
def vector_search(s: Store) -> DataFrame:
    return vectors.search(_records(s), _queries(s), 10)


@query("vs04_best_sections", f"WITH b AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, e.label AS section_id, {_DOT} AS score FROM embeddings e JOIN embeddings q ON true WHERE q.vec_id % 50 = 0) SELECT * FROM b WHERE score >= 0.1")
def best_sections(s: Store) -> DataFrame:
    return vectors.best_sections(_records(s), _queries(s), 0.1)


@query("x33_unit_vectors", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings")
def unit_vectors(s: Store) -> DataFrame:
    return s.raw("embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


# recall: benchmark items are queries; sources of documents are tags; embeddings of the same id are the vectors
_BM25 = r"""t AS (SELECT doc_id AS entry_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9À-ÿ]+')) AS term FROM documents),
  q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9À-ÿ]+')) AS term FROM benchmark),
  dl AS (SELECT d.doc_id AS entry_id, len(regexp_extract_all(lower(d.text), '[A-Za-z0-9À-ÿ]+')) AS dl FROM documents d),
  st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
  tf AS (SELECT entry_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  w AS (SELECT tf.term, tf.entry_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS w FROM tf JOIN df USING (term) JOIN dl USING (entry_id), st),
  bm AS (SELECT query_id, entry_id, round(sum(w), 6) AS score FROM q JOIN w USING (term) GROUP BY ALL)"""
_MERGED = f"""WITH {_BM25}, lx AS (SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS r FROM bm QUALIFY r <= 30),
  vv AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, {_DOT} AS score FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
  sx AS (SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS r FROM vv QUALIFY r <= 30),
  tx AS (SELECT item_id AS query_id, doc_id AS entry_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS r FROM benchmark JOIN documents ON source = 'src' || (item_id % 20) QUALIFY r <= 30),
  u AS (SELECT query_id, entry_id, r AS t, NULL AS x, NULL AS s FROM tx UNION ALL SELECT query_id, entry_id, NULL, r, NULL FROM lx UNION ALL SELECT query_id, entry_id, NULL, NULL, r FROM sx),
  mg AS (SELECT query_id, entry_id, CAST(min(t) AS INTEGER) AS tag_rank, CAST(min(x) AS INTEGER) AS lexical_rank, CAST(min(s) AS INTEGER) AS semantic_rank FROM u GROUP BY ALL),
  sc AS (SELECT *, CASE WHEN lexical_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN 'overlap' WHEN tag_rank IS NOT NULL THEN 'tag' WHEN lexical_rank IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS bucket,
    coalesce(1.0 / (60 + tag_rank), 0.0) + coalesce(1.0 / (60 + lexical_rank), 0.0) + coalesce(1.0 / (60 + semantic_rank), 0.0) AS rrf,
    round(1000 * (coalesce(1.0 / (60 + tag_rank), 0.0) + coalesce(1.0 / (60 + lexical_rank), 0.0) + coalesce(1.0 / (60 + semantic_rank), 0.0)) +
    CASE WHEN tag_rank IS NOT NULL THEN 1.2 ELSE 0.0 END + CASE WHEN lexical_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN 1.5 ELSE 0.0 END
    + CASE WHEN tag_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 0.8 ELSE 0.0 END + CASE WHEN tag_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN 0.5 ELSE 0.0 END, 4) AS score FROM mg)"""
_QUOTA = (
    _MERGED
    + """, qt AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, rrf DESC, entry_id) AS rn FROM sc),
  gr AS (SELECT *, CASE WHEN bucket = 'overlap' AND rn <= 4 THEN 0 WHEN bucket = 'tag' AND rn <= 2 THEN 1 WHEN bucket = 'lexical' AND rn <= 2 THEN 2 WHEN bucket = 'semantic' AND rn <= 2 THEN 3 ELSE 4 END AS g FROM qt),
  ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g, score DESC, rrf DESC, entry_id) AS INTEGER) AS place FROM gr QUALIFY place <= 10)"""
)
_QRELS = "qr AS (SELECT item_id AS query_id, doc_id AS entry_id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


#: Indexes of this process by application, table and the state of its files.
_INDEXES: dict[tuple, search_index.Index] = {}


def _index(s: Store) -> search_index.Index:
    """The index of all documents, written once for all queries over the same files."""
    documents = s.raw("documents")
    files = sorted((r.file_path, r.file_size, r.file_modification_time) for r in documents.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect())
    key = (s.spark.sparkContext.applicationId, *files)
    if key not in _INDEXES:
        _INDEXES[key] = search_index.build(documents.select(F.col("doc_id").alias("entry_id"), "text"))
    return _INDEXES[key]


def _asked_texts(s: Store) -> DataFrame:
    return s.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(s: Store, k: int, rank: str) -> DataFrame:
    return search_index.search(_index(s), _asked_texts(s), k, rank).results


def _merged(s: Store) -> DataFrame:
    items = s.raw("benchmark").select(F.col("item_id").alias("query_id"))
    # a document's tag score is its own, so a source's best are found before queries meet them
    longest = F.row_number().over(W.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))
    tagged = s.raw("documents").select("doc_id", "source", longest.alias("tag_rank")).filter("tag_rank <= 30").select(F.col("doc_id").alias("entry_id"), "source", "tag_rank")
    tagged = tagged.join(items.withColumn("source", F.concat(F.lit("src"), F.col("query_id") % 20)), "source").select("query_id", "entry_id", "tag_rank")
    return retrieval.scored(retrieval.merge(tagged, _lexical(s, 30, "lexical_rank"), _semantic(s)))


def _evidence(s: Store) -> DataFrame:
    return retrieval.select_evidence(_merged(s), 10)


def _judgements(s: Store) -> DataFrame:
    """Documents that hold a benchmark passage: candidates share its longest word but the first and last, which the text may go on."""
    words = F.split("item", r"\s+")
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(1)))).otherwise(words)
    word = F.element_at(F.array_sort(inner, lambda x, y: F.length(x) - F.length(y)), -1)
    items = s.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item")).withColumn("w", word)
    docs = s.raw("documents").select(F.col("doc_id").alias("entry_id"), "text")
    words = docs.select("entry_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).join(items.select("w").distinct(), "w", "left_semi")
    met = words.join(items, "w").join(docs, "entry_id").filter(F.contains("text", "item"))
    return met.select("query_id", "entry_id", F.lit(1).alias("rel")).distinct()


@query("f10_bm25", f"WITH {_BM25} SELECT query_id, entry_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 10".replace(", score,", ", score,"))
def bm25(s: Store) -> DataFrame:
    return _lexical(s, 10, "rank").select("query_id", "entry_id", "score", "rank")


@query("f10b_pruned_search", f"WITH {_BM25} SELECT query_id, entry_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 100")
def pruned_search(s: Store) -> DataFrame:
    return _lexical(s, 100, "rank").select("query_id", "entry_id", "score", "rank")


@query("x07_rrf_scores", _MERGED + " SELECT query_id, entry_id, tag_rank, lexical_rank, semantic_rank, bucket, CAST(score AS DOUBLE) AS score FROM sc")
def rrf_scores(s: Store) -> DataFrame:
    return _merged(s).drop("rrf")


@query(
    "x09_evidence_scores",
    with_store(
        """SELECT file_id, round(CAST(least(1.4 * 1.75 * least((length(lower(summary)) - length(replace(lower(summary), 'licensed', ''))) // 8, 2) +
      1.4 * 1.0 * least((length(lower(summary)) - length(replace(lower(summary), 'erst', ''))) // 4, 2), 2.0) + (CAST(contains(lower(summary), 'licensed') AS INT) + CAST(contains(lower(summary), 'erst') AS INT)) / 2.0 AS DOUBLE), 6) AS field_match,
      round(CAST(CASE WHEN trim(coalesce(summary, '')) <> '' THEN 0.4 ELSE 0 END + CASE WHEN size_bytes <= 500 THEN 0.3 ELSE 0 END + CASE WHEN size_bytes > 100 THEN 0.2 ELSE 0 END - CASE WHEN size_bytes > 5000 THEN 0.2 ELSE 0 END AS DOUBLE), 6) AS utility FROM files""",
        "files",
    ),
)
def evidence_scores(s: Store) -> DataFrame:
    match = retrieval.field_match(["Licensed", "erst"], {"summary": 1.4})
    size = F.col("size_bytes")
    utility = retrieval.evidence_utility(F.col("summary"), size > 500, F.when(size > 100, size).otherwise(0), size > 5000)
    return s.files.select("file_id", F.round(match, 6).alias("field_match"), F.round(utility, 6).alias("utility"))


@query("h01_recall", _QUOTA + " SELECT query_id, entry_id, bucket, CAST(score AS DOUBLE) AS score, place FROM ev")
def recall(s: Store) -> DataFrame:
    return _evidence(s).select("query_id", "entry_id", "bucket", "score", "place")


@query("h03_rerank", _QUOTA + ", rr AS (SELECT ev.*, n_chars AS outside FROM ev LEFT JOIN documents ON doc_id = entry_id AND doc_id % 3 <> 0) SELECT query_id, entry_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place > 6, CASE WHEN place <= 6 THEN outside END DESC NULLS LAST, place) AS INTEGER) AS place FROM rr")
def rerank(s: Store) -> DataFrame:
    chosen = _evidence(s)
    outside = s.raw("documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("entry_id"), F.col("n_chars").alias("score"))
    scores = chosen.select("query_id", "entry_id").join(outside, "entry_id")
    return retrieval.rerank(chosen.select("query_id", "entry_id", "place"), scores, 6).select("query_id", "entry_id", "place")


_LEX10 = f"WITH {_BM25}, {_QRELS}, run AS (SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS place FROM bm QUALIFY place <= 10)"
_PERQ = """, rel AS (SELECT query_id, count(*) AS relevant, list_sum(list_transform(range(1, least(10, count(*)) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM qr GROUP BY query_id),
  pq AS (SELECT rel.query_id, relevant, count(run.entry_id) AS returned, min(place) FILTER (WHERE qr.entry_id IS NOT NULL) AS first_rank, count(qr.entry_id) AS hits,
    coalesce(sum(1 / log2(place + 1)) FILTER (WHERE qr.entry_id IS NOT NULL), 0) / any_value(ideal) AS ndcg
    FROM rel LEFT JOIN run ON run.query_id = rel.query_id LEFT JOIN qr ON qr.query_id = run.query_id AND qr.entry_id = run.entry_id GROUP BY rel.query_id, relevant)"""


def _run(s: Store) -> DataFrame:
    return _lexical(s, 10, "place").select("query_id", "entry_id", "place")


@query("e01_per_query", _LEX10 + _PERQ + " SELECT query_id, CAST(relevant AS BIGINT) AS relevant, CAST(returned AS BIGINT) AS returned, CAST(first_rank AS INTEGER) AS first_rank, CAST(hits > 0 AS INTEGER) AS hit, round(hits / relevant, 6) AS recall, round(ndcg, 6) AS ndcg, round(coalesce(1.0 / first_rank, 0.0), 6) AS reciprocal_rank FROM pq")
def per_query(s: Store) -> DataFrame:
    return evaluation.per_query(_run(s), _judgements(s), 10)


@query("e04_summary", _LEX10 + _PERQ + " SELECT CAST(count(*) AS BIGINT) AS queries, round(avg(CAST(hits > 0 AS INT)), 6) AS hit_at_k, round(avg(round(hits / relevant, 6)), 6) AS recall_at_k, round(avg(round(ndcg, 6)), 6) AS ndcg_at_k, round(avg(round(coalesce(1.0 / first_rank, 0.0), 6)), 6) AS mrr, round(avg(CAST(returned = 0 AS DOUBLE)), 6) AS zero_result_rate, round(avg(CAST(hits = 0 AS DOUBLE)), 6) AS no_relevant_rate FROM pq")
def eval_summary(s: Store) -> DataFrame:
    return evaluation.summary(evaluation.per_query(_run(s), _judgements(s), 10))


_RUNS = {
    "lexical": "SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical_rank, entry_id) AS place FROM sc WHERE lexical_rank IS NOT NULL QUALIFY place <= 10",
    "semantic": "SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY semantic_rank, entry_id) AS place FROM sc WHERE semantic_rank IS NOT NULL QUALIFY place <= 10",
    "fused": "SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS place FROM sc QUALIFY place <= 10",
    "quota": "SELECT query_id, entry_id, place FROM ev",
}
_ABLATION = _QUOTA + f", {_QRELS}, runs AS (" + " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS config, query_id, entry_id, place FROM ({q})" for i, (n, q) in enumerate(_RUNS.items()))
_ABLATION += """), rel AS (SELECT query_id, count(*) AS relevant, list_sum(list_transform(range(1, least(10, count(*)) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM qr GROUP BY query_id),
  cf AS (SELECT DISTINCT position, config FROM runs),
  pq AS (SELECT position, config, rel.query_id, relevant, min(place) FILTER (WHERE qr.entry_id IS NOT NULL) AS first_rank, count(qr.entry_id) AS hits,
    coalesce(sum(1 / log2(place + 1)) FILTER (WHERE qr.entry_id IS NOT NULL), 0) / any_value(ideal) AS ndcg
    FROM cf JOIN rel ON true LEFT JOIN runs USING (position, config, query_id) LEFT JOIN qr ON qr.query_id = rel.query_id AND qr.entry_id = runs.entry_id GROUP BY position, config, rel.query_id, relevant),
  sm AS (SELECT position, config, round(avg(CAST(hits > 0 AS INT)), 6) AS hit_at_k, round(avg(round(hits / relevant, 6)), 6) AS recall_at_k, round(avg(round(ndcg, 6)), 6) AS ndcg_at_k, round(avg(round(coalesce(1.0 / first_rank, 0.0), 6)), 6) AS mrr FROM pq GROUP BY position, config)
  SELECT s.*, """ + ", ".join(f"round(s.{m} - b.{m}, 6) AS {m}_delta" for m in ("hit_at_k", "recall_at_k", "ndcg_at_k", "mrr")) + " FROM sm s JOIN sm b ON b.position = 0"


#: The same recall without tags.
_EVAL = _MERGED.replace("SELECT query_id, entry_id, r AS t, NULL AS x, NULL AS s FROM tx UNION ALL SELECT query_id, entry_id, NULL, r, NULL FROM lx", "SELECT query_id, entry_id, CAST(NULL AS INTEGER) AS t, r AS x, CAST(NULL AS INTEGER) AS s FROM lx")


def _semantic(s: Store) -> DataFrame:
    items = s.raw("benchmark").select(F.col("item_id").alias("query_id"))
    asked = s.raw("embeddings").join(items, F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("query"))
    return vectors.search(_records(s), asked, 30).withColumnRenamed("rank", "semantic_rank")


def _recalled(s: Store) -> DataFrame:
    """What evaluation recalls: words and vectors, without tags."""
    return retrieval.scored(retrieval.merge(_lexical(s, 30, "lexical_rank"), _semantic(s)))


@query(
    "e05_retrievers",
    _EVAL + " SELECT 'lexical' AS retriever, query_id, entry_id, CAST(x AS INTEGER) AS place FROM u WHERE x <= 10 UNION ALL SELECT 'semantic', query_id, entry_id, CAST(s AS INTEGER) FROM u WHERE s <= 10 UNION ALL SELECT 'recall', query_id, entry_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS INTEGER) AS place FROM sc QUALIFY place <= 10",
)
def retrievers(s: Store) -> DataFrame:
    """The same queries by words, by vectors, and by both."""
    merged = written(_recalled(s))
    runs = {r: merged.filter(F.col(f"{r}_rank") <= 10).select("query_id", "entry_id", F.col(f"{r}_rank").alias("place")) for r in ("lexical", "semantic")}
    runs["recall"] = retrieval.ranked(merged, 10, "place")
    rows = [r.select(F.lit(n).alias("retriever"), "query_id", "entry_id", "place") for n, r in runs.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("e06_batched_recall", _EVAL + " SELECT query_id, entry_id, lexical_rank, semantic_rank, bucket, CAST(score AS DOUBLE) AS score FROM sc")
def batched_recall(s: Store) -> DataFrame:
    return _recalled(s).select("query_id", "entry_id", "lexical_rank", "semantic_rank", "bucket", "score")


@query(
    "e07_eval_quotas",
    _EVAL
    + """, qt AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, rrf DESC, entry_id) AS rn FROM sc),
  gr AS (SELECT *, CASE WHEN bucket = 'overlap' AND rn <= 4 THEN 0 WHEN bucket = 'lexical' AND rn <= 4 THEN 1 WHEN bucket = 'semantic' AND rn <= 2 THEN 2 ELSE 3 END AS g FROM qt)
  SELECT query_id, entry_id, bucket, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g, score DESC, rrf DESC, entry_id) AS INTEGER) AS place FROM gr QUALIFY place <= 10""",
)
def eval_quotas(s: Store) -> DataFrame:
    return retrieval.select_evidence(_recalled(s), 10, retrieval.EVAL_QUOTAS).select("query_id", "entry_id", "bucket", "place")


@query("e08_ablation", _ABLATION)
def ablation(s: Store) -> DataFrame:
    merged = written(_merged(s))  # four configurations read it
    place = {n: retrieval.ranked(merged.filter(f"{r} IS NOT NULL").withColumn("score", -F.col(r)), 10, "place") for n, r in (("lexical", "lexical_rank"), ("semantic", "semantic_rank"))}
    return evaluation.ablation({**place, "fused": retrieval.ranked(merged, 10, "place"), "quota": retrieval.select_evidence(merged, 10)}, written(_judgements(s)), 10)


@query("e09_latency", "SELECT user_id, CAST(count(*) AS BIGINT) AS requests, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(CAST(event_type = 'error' AS DOUBLE)), 6) AS error_rate, CAST(round(quantile_cont(value, 0.95), 6) > 30 AS INTEGER) + CAST(round(avg(CAST(event_type = 'error' AS DOUBLE)), 6) > 0.2 AS INTEGER) AS violations FROM events GROUP BY user_id")
def latency(s: Store) -> DataFrame:
    rows = s.raw("events").select("user_id", F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("error"))
    return evaluation.latency(rows, ["user_id"], {"p95": 30.0, "error_rate": 0.2})


_ADHOC = {
    "s2_join_aggregate": 'SELECT n_name AS nation, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM t1 JOIN t2 ON o_custkey = c_custkey JOIN t3 ON c_nationkey = n_nationkey GROUP BY n_name',
    "s2_window": "SELECT o_orderkey AS id, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS place, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running FROM t1",
    "s2_cube": "SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n FROM t1 GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "s2_set_operations": "SELECT c_nationkey AS k FROM t2 EXCEPT SELECT n_nationkey FROM t3 WHERE n_regionkey = 1",
    "s2_subquery": "SELECT c_custkey AS id FROM t2 WHERE c_acctbal > (SELECT avg(c_acctbal) FROM t2) AND EXISTS (SELECT 1 FROM t1 WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
}


def _register(name: str, text: str) -> None:
    views = (("t1", "orders"), ("t2", "customer"), ("t3", "nation"))
    body = f"WITH {', '.join(f'{v} AS (SELECT * FROM {t})' for v, t in views)} {text}"

    @query(name, body)
    def adhoc(s: Store) -> DataFrame:
        return run_sql(s.spark, [s.raw(t) for _, t in views], text, limit=None).rows


for _name, _text in _ADHOC.items():
    _register(_name, _text)


@query("st1_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(s: Store) -> DataFrame:
    return windows.tumbling(s.raw("events"))


@query("st2_sliding", "SELECT start, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i) FOR i IN range(4)]) AS start FROM events) GROUP BY start")
def sliding(s: Store) -> DataFrame:
    return windows.sliding(s.raw("events"))


@query("st3_sessions", "SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
def user_sessions(s: Store) -> DataFrame:
    return windows.sessions(s.raw("events"))
