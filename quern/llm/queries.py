"""The registered queries of this package: each applies one operator to its whole table, at production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import alignment, chat, collocations, language_model, licenses, mixing, packing, quality_classifier, quality_rules, repeats, sharding, simhash, topk
from quern.llm.text import held_out
from quern.plans.columns import pick
from quern.plans.lineage import fresh_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Byte-level ids, which are decoded to exactly the text they are of.
CHAT_TOKENS = chat.tokens_of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
#: A byte-level BPE's ranks and pattern, and a piece model.
ALIGNED = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
#: Share of the largest entropy, log(sources), that mixing aims at.
TARGET_ENTROPY = 0.9
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), target_entropy=TARGET_ENTROPY)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_model.train(docs, ~held_out(7, 2))
    scored = language_model.score(docs, model)
    return scored.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), TOKENIZER, digest_only=True)
    return packing.pack(pieces)


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality_classifier.train(docs, table(spark, sf_dir, "labels"), ~quality_classifier.is_held_out())
    scored = quality_classifier.score(docs, weights)
    return scored.select("doc_id", quality_classifier.is_held_out().alias("held_out"), "score", "predicted")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    test = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.read_back(chat.prefix_trees(rows.unionByName(test), CHAT_TOKENS)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards to the shared folder and tells what is in them."""
    folder = fresh_dir(spark, "shards")
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS, ["doc_id", "text"])
    sharding.write_shards(placed, folder)
    sharded = sharding.read_shards(spark, folder, placed.schema)
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharded.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy goes, the first one too; `repeats.remove_repeats` keeps the first unless told otherwise."""
    cleaned = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep="none", digest_only=True)
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), ALIGNED, digest_only=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mix_sources, op2_lm_scores, op3_pack_sequences, op4_quality_scores, op5_near_duplicates, op6_top_k, op7_chat_format, op8_quality_rules, op9_license_scan, op10_shuffle_shards, op11_collocations, op12_repeats, op13_align_tokenizers)
    return {f.__name__: f for f in found}


#: Control strings of chat.py with their first character apart, for a dialect without look-ahead.
_CONTROL = r"([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"


def oracle_sql() -> dict[str, str]:
    return {
        "op6_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
        "op7_chat_format": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', NULL), (-1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL)
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<|turn|><|text|><|end|>') + length(regexp_replace(role, '{_CONTROL}', '\1\\\2\3', 'g'))
      + length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g'))) AS formatted
  FROM c GROUP BY conv_id, alone
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM g
""",
        "op11_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f1 AS (SELECT lang, ws[i] AS x, count(*) AS f FROM o GROUP BY ALL),
f2 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS f FROM o WHERE i + 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS f FROM o WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
c2 AS (
  SELECT p.lang, p.x || ' ' || p.y AS phrase, p.f AS a, l.f AS l, r.f AS r, 1 AS k
  FROM f2 p JOIN f1 l ON l.lang = p.lang AND l.x = p.x JOIN f1 r ON r.lang = p.lang AND r.x = p.y
  WHERE NOT EXISTS (SELECT 1 FROM f3 q WHERE q.lang = p.lang AND ((q.x = p.x AND q.y = p.y) OR (q.y = p.x AND q.z = p.y)) AND 100 * q.f >= 50 * p.f)
), c3 AS (
  SELECT p.lang, p.x || ' ' || p.y || ' ' || p.z AS phrase, p.f AS a, l.f AS l, r.f AS r, 1 AS k
  FROM f3 p JOIN f1 l ON l.lang = p.lang AND l.x = p.x JOIN f2 r ON r.lang = p.lang AND r.x = p.y AND r.y = p.z
  UNION ALL
  SELECT p.lang, p.x || ' ' || p.y || ' ' || p.z, p.f, l.f, r.f, 2
  FROM f3 p JOIN f2 l ON l.lang = p.lang AND l.x = p.x AND l.y = p.y JOIN f1 r ON r.lang = p.lang AND r.x = p.z
), s AS (
  SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c3)
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, CAST(n.n AS BIGINT) AS n, t.score FROM t JOIN n ON n.lang = t.lang WHERE t.rank <= 2000
""",
    }
