"""Further mining, log, graph, index and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.binding import Store, with_store
from quern.operators import documents, graph, kept, lifecycle, logs, store, vector_table, vectors
from quern.operators.components import connected_components
from quern.plans.lineage import fresh_dir
from quern.queries import query
from quern.streaming import leases, ledger, windows


@query("m02_cocitation", "WITH c AS (SELECT DISTINCT user_id AS id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CAST(json_extract(props, '$.k') AS INT) AS e FROM events) SELECT CAST(x.e AS VARCHAR) AS a, CAST(y.e AS VARCHAR) AS b, CAST(count(*) AS BIGINT) AS observation_count FROM c x JOIN c y ON x.id = y.id AND x.day = y.day AND CAST(x.e AS VARCHAR) < CAST(y.e AS VARCHAR) GROUP BY ALL HAVING count(*) >= 2")
def cocitation(s: Store) -> DataFrame:
    """A user's day is an answer; it cites the keys of its events."""
    note = F.concat(F.lit("[^"), "event_id", F.lit("]: entry_id="), F.get_json_object("props", "$.k"))
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    answers = s.raw("events").groupBy(F.concat_ws("/", "user_id", day).alias("id")).agg(F.array_join(F.collect_list(note), "\n").alias("text"))
    cited = documents.citations(answers).select("id", "entry_id").distinct()
    return graph.pair_counts(cited, 2)


_LINES = "SELECT line_no, text, CASE WHEN regexp_matches(text, '(?i)\\b(ERROR|ERR|SEVERE)\\b') THEN 'ERROR' WHEN regexp_matches(text, '(?i)\\b(WARN|WARNING)\\b') THEN 'WARN' WHEN regexp_matches(text, '(?i)\\b(INFO|NOTICE)\\b') THEN 'INFO' ELSE 'DEBUG' END AS level FROM log_lines"


@query("l05_pattern_hits", with_store(f"SELECT line_no, CAST(i - 1 AS INTEGER) AS hit, m[i] AS match, level FROM (SELECT line_no, level, regexp_extract_all(text, '[a-z]+=?[0-9]+') AS m FROM ({_LINES})), unnest(range(1, len(m) + 1)) t(i) ORDER BY line_no, hit LIMIT 500 OFFSET 100", "log_lines"))
def pattern_hits(s: Store) -> DataFrame:
    return logs.pattern_hits(s.log_lines, "[a-z]+=?[0-9]+", 500, 100)


@query("l06_level_at_least", with_store(f"SELECT line_no FROM ({_LINES}) WHERE level IN ('WARN', 'ERROR')", "log_lines"))
def at_least(s: Store) -> DataFrame:
    return logs.at_least(s.log_lines, "warn").select("line_no")


@query("g03_direct_weight", with_store("SELECT a AS seed, b AS node, CAST(observation_count AS BIGINT) AS direct FROM edges", "edges"))
def direct_weight(s: Store) -> DataFrame:
    return graph.adjacency(s.edges).filter("src < dst").select(F.col("src").alias("seed"), F.col("dst").alias("node"), F.col("weight").alias("direct"))


@query("g07_component_tags", """WITH g AS (SELECT min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component, c_custkey AS node FROM customer),
  s AS (SELECT component, count(*) AS members FROM g GROUP BY component HAVING count(*) >= 2), t AS (SELECT DISTINCT o_custkey AS node, o_orderstatus AS tag FROM orders),
  c AS (SELECT component, members, tag FROM g JOIN s USING (component) JOIN t USING (node) GROUP BY ALL HAVING count(DISTINCT node) = members)
  SELECT component, CAST(members AS BIGINT) AS members, string_agg(tag, ',' ORDER BY tag) AS tags FROM c GROUP BY component, members""")  # fmt: skip
def component_tags(s: Store) -> DataFrame:
    """Customers that share a nation and a segment are one component; its orders' statuses are tags."""
    c = s.raw("customer")
    first = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("a"))
    edges = c.join(first, ["c_nationkey", "c_mktsegment"]).select("a", F.col("c_custkey").alias("b"))
    tags = s.raw("orders").select(F.col("o_custkey").alias("entry_id"), F.col("o_orderstatus").alias("tag_id")).distinct()
    return graph.clusters(edges, tags, 2, 1).withColumn("tags", F.array_join("tags", ","))


@query("vs05_refresh", "SELECT doc_id AS entry_id, EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 3 = 0 AND sha256(o.text) = sha256(d.text)) AS reused FROM documents d")
def refresh(s: Store) -> DataFrame:
    rows = s.raw("documents").select(F.col("doc_id").alias("entry_id"), F.sha2("text", 256).alias("text_hash"))
    index = rows.filter("entry_id % 3 = 0").select("text_hash", F.array(F.lit(1.0)).alias("vector"))
    kept, new = vectors.refresh(index, rows)
    return kept.select("entry_id", F.lit(True).alias("reused")).union(new.select("entry_id", F.lit(False)))


@query("vs05b_kept_vectors", "SELECT doc_id AS entry_id, sha256(coalesce(text, '')) AS text_hash, CAST(length(coalesce(text, '')) AS DOUBLE) AS size FROM documents")
def kept_vectors(s: Store) -> DataFrame:
    """A table of all documents in three states: other texts, without a fifth, and as given; its vectors are a text's length."""
    docs = s.raw("documents").select((F.col("doc_id") % 97).alias("file_id"), F.col("doc_id").alias("entry_id"), F.lit(None).cast("string").alias("section_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = lambda rows: rows.withColumn("text_hash", F.sha2("text", 256))
    embed = lambda rows: rows.withColumn("vector", F.array(F.length("text").cast("double")))
    folder = fresh_dir(s.spark, "vectors")
    vector_table.build(hashed(docs.withColumn("text", F.when(F.col("file_id") < 9, F.concat(F.lit("old "), "text")).otherwise(F.col("text")))), embed, folder, 16)
    vector_table.refresh(hashed(docs.filter("entry_id % 5 <> 1")), embed, folder, 16)
    vector_table.refresh(hashed(docs), embed, folder, 16)
    return vector_table.read(s.spark, folder).select("entry_id", "text_hash", F.col("vector")[0].alias("size"))


@query("m16_refresh_candidates", with_store("SELECT entry_id, CAST(count(*) AS BIGINT) AS n FROM mentions GROUP BY entry_id HAVING count(*) >= 3 ORDER BY n DESC, entry_id LIMIT 20", "mentions"))
def refresh_candidates(s: Store) -> DataFrame:
    return s.mentions.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").orderBy(F.col("n").desc(), "entry_id").limit(20)


@query("m01b_capped_new_pairs", with_store("""SELECT a, b, CAST(observation_count AS BIGINT) AS observation_count, is_new FROM (SELECT *, sum(CAST(is_new AS INT)) OVER (ORDER BY observation_count DESC, a, b) AS n FROM
  (SELECT a, b, observation_count, (a + b) % 3 <> 0 AS is_new FROM edges)) WHERE n < 50 OR (n = 50 AND is_new)""", "edges"))  # fmt: skip
def capped_new_pairs(s: Store) -> DataFrame:
    return lifecycle.capped_new(s.edges, s.edges.filter("(a + b) % 3 = 0").select("a", "b"), 50)


@query("k07_keyset_ascending", "SELECT p_partkey AS id FROM part WHERE p_partkey > 77 ORDER BY p_partkey LIMIT 31")
def keyset_ascending(s: Store) -> DataFrame:
    return s.raw("part").select(F.col("p_partkey").alias("id")).filter("id > 77").orderBy("id").limit(31)


@query("w09_oldest_name", with_store("SELECT folder_id, arg_min(display_name, (created_at, entry_id)) AS name FROM entries GROUP BY folder_id", "entries"))
def oldest_name(s: Store) -> DataFrame:
    return s.entries.groupBy("folder_id").agg(F.min_by("display_name", F.struct("created_at", "entry_id")).alias("name"))


@query("k01_rank_then_recent", with_store("SELECT entry_id FROM entries WHERE deleted_at IS NULL ORDER BY contains(display_name, '7') DESC, updated_at DESC, entry_id LIMIT 30 OFFSET 15", "entries"))
def rank_then_recent(s: Store) -> DataFrame:
    rows = s.entries.filter("deleted_at IS NULL").orderBy(F.contains("display_name", F.lit("7")).desc(), F.col("updated_at").desc(), "entry_id")
    return rows.offset(15).limit(30).select("entry_id")


@query("w07_collapse_hits", "SELECT label AS section, CAST(row_number() OVER (ORDER BY v, label) AS INTEGER) AS place FROM (SELECT label, min(vec_id) AS v FROM embeddings GROUP BY label) QUALIFY place <= 100")
def collapse_hits(s: Store) -> DataFrame:
    hits = s.raw("embeddings").select(F.col("label").alias("section"), F.col("vec_id").alias("place"))
    return store.ordered_union([hits], ["section"], 100)


@query("st4_first_in_slot", "SELECT DISTINCT event_type, CAST(floor(epoch(ts) / 600) AS BIGINT) AS slot FROM events")
def first_in_slot(s: Store) -> DataFrame:
    return windows.first_in_slot(s.raw("events"))


@query("st5_ledger", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS cursor FROM events")
def event_ledger(s: Store) -> DataFrame:
    """The stream of all events, run to its end into a ledger."""
    folder = fresh_dir(s.spark, "ledger")
    events = s.stream("events").select("event_id", "user_id", "ts")
    ledger.start(events, folder, f"{folder}/marks", "user_id", ["ts", "event_id"]).awaitTermination()
    return ledger.read(s.spark, folder).select("event_id", "user_id", "cursor")


@query(
    "st6_leases",
    """WITH m AS (SELECT max(o_orderdate) - INTERVAL 1 HOUR AS now FROM orders), t AS (SELECT o_orderkey AS task_id, o_orderkey % 5 AS attempts, o_orderdate + to_days(CAST(o_orderkey % 7 AS INT)) + INTERVAL 10 SECOND AS ended_at FROM orders WHERE o_orderstatus <> 'F')
  SELECT task_id, CASE WHEN attempts >= 3 THEN 'dead' ELSE 'pending' END AS status, ended_at FROM t, m WHERE ended_at < m.now""",
)
def stream_of_leases(s: Store) -> DataFrame:
    """The stream of all tasks' claims, run to its end: those whose lease ran out before the watermark."""
    folder = fresh_dir(s.spark, "leases")
    claims = s.stream("orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"), (F.col("o_orderkey") % 5).alias("attempts"),
        F.expr("timestampadd(DAY, CAST(o_orderkey % 7 AS INT), o_orderdate)").alias("lease_until"),
    )
    told = leases.expired(claims)
    told.writeStream.format("parquet").option("path", f"{folder}/told").option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start().awaitTermination()
    return s.spark.read.schema(told.schema).parquet(f"{folder}/told").select("task_id", "status", F.col("at").cast("timestamp_ntz").alias("ended_at"))


_CHAINS = """WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 5 <> 2), n AS (SELECT k AS node FROM k UNION SELECT k + 1 FROM k),
    f AS (SELECT node, CASE WHEN node - 1 NOT IN (SELECT k FROM k) THEN node END AS first FROM n) SELECT node, max(first) OVER (ORDER BY node) AS component FROM f"""


@query("g06b_components_kept", _CHAINS)
def components_kept(s: Store) -> DataFrame:
    """Links of customers in three batches: most of them, then some new ones while others go, then the rest."""
    orders = s.raw("orders").select((F.col("o_orderkey") % 5).alias("r"), F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1).alias("b"))
    edges = lambda *r: orders.filter(F.col("r").isin(*r)).select("a", "b").distinct()
    labels = connected_components(edges(0, 2))
    gone = edges(2).join(edges(0, 1), ["a", "b"], "left_anti")
    labels = kept.update_components(labels, edges(0, 1), edges(1), gone)
    return kept.update_components(labels, edges(0, 1, 3, 4), edges(3, 4))


@query("j14b_state_as_of", with_store("SELECT entry_id, CASE WHEN entry_id % 5 = 1 THEN 'demoted' WHEN entry_id % 3 = 1 THEN 'archived' ELSE lifecycle END AS lifecycle FROM entries WHERE entry_id % 7 <> 2", "entries"))
def state_as_of(s: Store) -> DataFrame:
    """Three versions of changes over all entries; the second takes a seventh out, a fourth isn't asked for."""
    base = s.entries.select("entry_id", "lifecycle")
    change = lambda where, to, version, deleted=False: base.filter(where).select("entry_id", F.lit(to).alias("lifecycle"), F.lit(version).alias("version"), F.lit(deleted).alias("deleted"))
    log = change("entry_id % 3 = 1", "archived", 1).union(change("entry_id % 7 = 2", None, 2, True)).union(change("entry_id % 5 = 1 AND entry_id % 7 <> 2", "demoted", 3)).union(change("entry_id % 2 = 0", "lost", 4))
    return kept.as_of(base, log, "entry_id", 3)


@query("a27b_merged_summaries", "SELECT date_trunc('month', ts) AS start, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last, true AS users_near, true AS median_near FROM events GROUP BY ALL")
def merged_summaries(s: Store) -> DataFrame:
    """Months from sketches of hours; the estimates are held against exact counts and ranks over all events."""
    events = s.raw("events")
    months = kept.told(kept.merged(kept.merged(kept.summaries(events), "day"), "month"))
    month = F.date_trunc("month", "ts").cast("timestamp_ntz")
    said = months.select(F.col("start").alias("_s"), F.col("event_type").alias("_e"), "p50")
    exact = events.join(said, (month == F.col("_s")) & (F.col("event_type") == F.col("_e"))).groupBy(month.alias("start"), "event_type").agg(
        F.countDistinct("user_id").alias("_users"), F.avg((F.col("value") < F.col("p50")).cast("int")).alias("_below"), F.avg((F.col("value") <= F.col("p50")).cast("int")).alias("_upto")
    )
    rows = months.join(exact, ["start", "event_type"])
    near = F.abs(F.col("users") - F.col("_users")) <= F.greatest(F.lit(1.0), 0.06 * F.col("_users"))
    return rows.select("start", "event_type", "n", "first", "last", near.alias("users_near"), ((F.col("_below") <= 0.52) & (F.col("_upto") >= 0.48)).alias("median_near"))
