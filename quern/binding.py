"""The given tables seen as a knowledge base, in Spark and in SQL.

Each table of the store is a projection of a given one, so that every registered query grows with its input.
`STORE_SQL` states the same projections for the SQL that results are compared with.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Store time runs from here.
EPOCH = "2024-01-01 00:00:00"
NOW = "2024-03-01 00:00:00"


@dataclass
class Store:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files; named by a pattern, since a path that is one file can't be a stream's base."""
        return self.spark.readStream.schema(self.raw(name).schema).parquet(f"{self.sf_dir}/[{name[0]}]{name[1:]}.parquet")

    def _sql(self, query: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(query, **frames)

    @cached_property
    def files(self) -> DataFrame:
        return self._sql(
            f"""SELECT doc_id AS file_id, sha2(text, 256) AS sha256, n_chars AS size_bytes, '.txt' AS original_ext, 'text' AS kind,
              substring(trim(regexp_replace(text, '\\\\s+', ' ')), 1, 500) AS summary, text AS body,
              CASE WHEN n_chars % 10 = 0 THEN 'pending' WHEN n_chars % 10 = 1 THEN 'failed' ELSE 'done' END AS ingest_status,
              timestampadd(HOUR, CAST(doc_id % 1000 AS INT), TIMESTAMP_NTZ '{EPOCH}') AS ingested_at,
              CASE WHEN doc_id % 23 = 5 THEN TIMESTAMP_NTZ '{NOW}' END AS deleted_at
            FROM {{d}}""",
            d=self.raw("documents"),
        )

    @cached_property
    def entries(self) -> DataFrame:
        return self._sql(
            f"""SELECT d.doc_id AS entry_id, d.doc_id AS file_id, concat('doc_', d.doc_id, '.txt') AS display_name,
              d.source AS folder_id, d.lang AS catalog_id,
              CASE WHEN l.quality = 0 THEN 'demoted' WHEN l.toxic = 1 THEN 'archived' WHEN l.quality = 1 THEN 'manual_active' ELSE 'active' END AS lifecycle,
              timestampadd(HOUR, CAST(d.doc_id % 1000 AS INT), TIMESTAMP_NTZ '{EPOCH}') AS created_at,
              timestampadd(HOUR, CAST(d.doc_id * 37 % 1400 AS INT), TIMESTAMP_NTZ '{EPOCH}') AS updated_at,
              CASE WHEN d.doc_id % 17 = 3 THEN timestampadd(HOUR, CAST(d.doc_id % 1300 AS INT), TIMESTAMP_NTZ '{EPOCH}') END AS deleted_at
            FROM {{d}} d LEFT JOIN {{l}} l ON d.doc_id = l.doc_id""",
            d=self.raw("documents").drop("text"), l=self.raw("labels"),
        )

    @cached_property
    def entry_tags(self) -> DataFrame:
        return self._sql(
            """SELECT doc_id AS entry_id, 'language' AS facet, lang AS name FROM {d}
            UNION ALL SELECT doc_id, 'source', source FROM {d}
            UNION ALL SELECT doc_id, 'form', CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END FROM {d}
            UNION ALL SELECT doc_id, 'topic', CASE WHEN quality = 1 THEN 'clean' ELSE 'junk' END FROM {l} WHERE quality IS NOT NULL
            UNION ALL SELECT doc_id, 'topic', 'toxic' FROM {l} WHERE toxic = 1""",
            d=self.raw("documents").drop("text"), l=self.raw("labels"),
        )

    @cached_property
    def folders(self) -> DataFrame:
        return self._sql(
            """SELECT 'world' AS id, CAST(NULL AS STRING) AS parent_id, 'World' AS name, false AS deleted
            UNION ALL SELECT concat('r', r_regionkey), 'world', r_name, false FROM {r}
            UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name, n_nationkey % 13 = 7 FROM {n}
            UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), c_name, c_custkey % 50 = 0 FROM {c}""",
            r=self.raw("region"), n=self.raw("nation"), c=self.raw("customer"),
        )

    @cached_property
    def journal(self) -> DataFrame:
        """A note for each order: the parts it mentions are the entries."""
        return self._sql(
            """SELECT o.o_orderkey AS id, o.o_custkey AS conversation_id, o.o_orderpriority AS note, l.entry_ids,
              array(o.o_orderpriority, o.o_orderstatus) AS tags, o.o_orderdate AS created_at,
              CASE o.o_orderstatus WHEN 'F' THEN 'insight' WHEN 'O' THEN 'note' ELSE 'verified' END AS source_kind,
              o.o_orderkey % 11 = 4 AS superseded, o.o_orderkey % 29 = 8 AS invalidated
            FROM {o} o JOIN (SELECT l_orderkey, array_sort(collect_set(l_partkey)) AS entry_ids FROM {l} GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
            o=self.raw("orders"), l=self.raw("lineitem").select("l_orderkey", "l_partkey"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        """note id, entry id: distinct, straight from the lines."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("entry_id")).distinct()

    @cached_property
    def supplier_tags(self) -> DataFrame:
        """Suppliers as entries, the parts they supply as tags."""
        return self.raw("lineitem").select(F.col("l_suppkey").alias("entry_id"), F.col("l_partkey").alias("tag_id")).distinct()

    @cached_property
    def edges(self) -> DataFrame:
        """An undirected weighted graph: suppliers that follow one another by key within an order."""
        # an order's lines meet in a frame, so they move once; a join with themselves moves them twice
        pairs = self._sql(
            """SELECT DISTINCT l_orderkey, a, b FROM (SELECT l_orderkey, l_suppkey AS a, explode(_next) AS b FROM (
              SELECT l_orderkey, l_suppkey, collect_set(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS _next
              FROM {l} WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL)) WHERE a < b""",
            l=self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"),
        )
        return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("observation_count"))

    @cached_property
    def log_lines(self) -> DataFrame:
        return self._sql(
            """SELECT event_id AS line_no, concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), ' ',
              CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END,
              ' ', event_type, ' by user=', user_id, ' ', props) AS text FROM {e}""",
            e=self.raw("events"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        return self._sql(
            """SELECT o_orderkey AS id, o_custkey AS dedup_key, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
              CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS scheduled_at,
              timestampadd(DAY, CAST(o_orderkey % 7 AS INT), o_orderdate) AS finished_at, o_totalprice AS cost, CAST(o_orderkey % 5 AS INT) AS attempts FROM {o}""",
            o=self.raw("orders"),
        )


_TS = f"TIMESTAMP '{EPOCH}'"
STORE_SQL: dict[str, str] = {
    "files": f"""SELECT doc_id AS file_id, sha256(text) AS sha256, n_chars AS size_bytes, '.txt' AS original_ext, 'text' AS kind,
      substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 500) AS summary, text AS body,
      CASE WHEN n_chars % 10 = 0 THEN 'pending' WHEN n_chars % 10 = 1 THEN 'failed' ELSE 'done' END AS ingest_status,
      {_TS} + to_hours(CAST(doc_id % 1000 AS INT)) AS ingested_at,
      CASE WHEN doc_id % 23 = 5 THEN TIMESTAMP '{NOW}' END AS deleted_at FROM documents""",
    "entries": f"""SELECT d.doc_id AS entry_id, d.doc_id AS file_id, 'doc_' || d.doc_id || '.txt' AS display_name,
      d.source AS folder_id, d.lang AS catalog_id,
      CASE WHEN l.quality = 0 THEN 'demoted' WHEN l.toxic = 1 THEN 'archived' WHEN l.quality = 1 THEN 'manual_active' ELSE 'active' END AS lifecycle,
      {_TS} + to_hours(CAST(d.doc_id % 1000 AS INT)) AS created_at, {_TS} + to_hours(CAST(d.doc_id * 37 % 1400 AS INT)) AS updated_at,
      CASE WHEN d.doc_id % 17 = 3 THEN {_TS} + to_hours(CAST(d.doc_id % 1300 AS INT)) END AS deleted_at
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "entry_tags": """SELECT doc_id AS entry_id, 'language' AS facet, lang AS name FROM documents
      UNION ALL SELECT doc_id, 'source', source FROM documents
      UNION ALL SELECT doc_id, 'form', CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END FROM documents
      UNION ALL SELECT doc_id, 'topic', CASE WHEN quality = 1 THEN 'clean' ELSE 'junk' END FROM labels WHERE quality IS NOT NULL
      UNION ALL SELECT doc_id, 'topic', 'toxic' FROM labels WHERE toxic = 1""",
    "folders": """SELECT 'world' AS id, CAST(NULL AS VARCHAR) AS parent_id, 'World' AS name, false AS deleted
      UNION ALL SELECT 'r' || r_regionkey, 'world', r_name, false FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey % 13 = 7 FROM nation
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, c_custkey % 50 = 0 FROM customer""",
    "journal": """SELECT o.o_orderkey AS id, o.o_custkey AS conversation_id, o.o_orderpriority AS note, l.entry_ids,
      [o.o_orderpriority, o.o_orderstatus] AS tags, o.o_orderdate AS created_at,
      CASE o.o_orderstatus WHEN 'F' THEN 'insight' WHEN 'O' THEN 'note' ELSE 'verified' END AS source_kind,
      o.o_orderkey % 11 = 4 AS superseded, o.o_orderkey % 29 = 8 AS invalidated
      FROM orders o JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS entry_ids FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
    "mentions": "SELECT DISTINCT l_orderkey AS id, l_partkey AS entry_id FROM lineitem",
    "supplier_tags": "SELECT DISTINCT l_suppkey AS entry_id, l_partkey AS tag_id FROM lineitem",
    "edges": """SELECT a, b, count(*) AS observation_count FROM (
      SELECT DISTINCT a.l_orderkey, a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b
      ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_suppkey < b.l_suppkey) GROUP BY a, b""",
    "log_lines": """SELECT event_id AS line_no, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' ||
      CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END ||
      ' ' || event_type || ' by user=' || user_id || ' ' || props AS text FROM events""",
    "tasks": """SELECT o_orderkey AS id, o_custkey AS dedup_key, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
      CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS scheduled_at,
      o_orderdate + to_days(CAST(o_orderkey % 7 AS INT)) AS finished_at, o_totalprice AS cost, CAST(o_orderkey % 5 AS INT) AS attempts FROM orders""",
}


def with_store(body: str, *names: str) -> str:
    """SQL over the store's tables: `body` behind the projections it needs."""
    return "WITH " + ", ".join(f"{n} AS ({STORE_SQL[n]})" for n in names) + "\n" + body
