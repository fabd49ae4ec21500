"""Hybrid recall: BM25, rank fusion, evidence scores, quotas, reranking. Everything is keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import hits, recall_weight
from quern.plans.lineage import cut

RRF_K = 60
#: Share of each bucket in the evidence, in order; what is left goes to the others.
QUOTAS = (("overlap", 0.35), ("tag", 0.20), ("lexical", 0.25))
#: The same in evaluation runs, which have no tag bucket.
EVAL_QUOTAS = (("overlap", 0.4), ("lexical", 0.4))
TOKEN = r"[A-Za-z0-9À-ÿ]+"


def terms_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("term"))
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(texts: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, entry_id, score of every text that shares a term. Only terms that a query has are indexed."""
    lengths = texts.select("entry_id", F.regexp_count(F.lower("text"), F.lit(TOKEN)).alias("dl"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    asked = terms_of(queries, "query_id", "text").select("query_id", "term")
    index = cut(terms_of(texts, "entry_id", "text").join(asked.select("term").distinct(), "term", "left_semi"))  # read twice: counts and weights
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = index.join(df, "term").join(lengths, "entry_id").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return asked.join(weighed.select("term", "entry_id", (idf * tf).alias("w")), "term").groupBy("query_id", "entry_id").agg(F.round(F.sum("w"), 6).alias("score"))


def ranked(scores: DataFrame, n: int, rank: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The n best entries of each query with their rank, and the columns to keep."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "entry_id"))
    return scores.withColumn(rank, place).filter(F.col(rank) <= n).select("query_id", "entry_id", *keep, rank)


def merge(*sources: DataFrame) -> DataFrame:
    """One row per query and entry with tag_rank, lexical_rank and semantic_rank (null: not found there)."""
    ranks = ("tag_rank", "lexical_rank", "semantic_rank")
    union = None
    for s in sources:
        row = s.select("query_id", "entry_id", *[F.col(r).cast("int").alias(r) if r in s.columns else F.lit(None).cast("int").alias(r) for r in ranks])
        union = row if union is None else union.unionByName(row)
    return union.groupBy("query_id", "entry_id").agg(*[F.min(r).alias(r) for r in ranks])


def rrf(ranks: tuple[str, ...] = ("tag_rank", "lexical_rank", "semantic_rank"), k: int = RRF_K) -> Column:
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return total


def bucket() -> Column:
    """overlap (lexical and semantic), else tag, lexical, semantic, other."""
    t, x, m = (F.col(c).isNotNull() for c in ("tag_rank", "lexical_rank", "semantic_rank"))
    return F.when(x & m, "overlap").when(t, "tag").when(x, "lexical").when(m, "semantic").otherwise("other")


def overlap_bonus() -> Column:
    """1.2 for tags, 1.5 for lexical with semantic, 0.8 for tags with lexical, 0.5 for tags with semantic."""
    t, x, m = (F.col(c).isNotNull() for c in ("tag_rank", "lexical_rank", "semantic_rank"))
    return F.when(t, 1.2).otherwise(0.0) + F.when(x & m, 1.5).otherwise(0.0) + F.when(t & x, 0.8).otherwise(0.0) + F.when(t & m, 0.5).otherwise(0.0)


def field_match(terms: list[str], fields: dict[str, float] | None = None) -> Column:
    """The weights of fields and the limits. At most 2 for weighted hits (two a field at most), plus the share of terms found."""
    fields = {"display_name": 2.4, "summary": 1.4, "kind": 0.2} if fields is None else fields
    raw, covered = F.lit(0.0), F.lit(0.0)
    for t in terms:
        found = F.lit(0.0)
        for column, weight in fields.items():
            found = found + F.lit(weight) * F.least(hits(F.col(column), t), F.lit(2))
        raw = raw + found * F.lit(recall_weight(t))
        covered = covered + F.when(found > 0, 1.0).otherwise(0.0)
    return F.least(raw, F.lit(2.0)) + covered / len(terms) if terms else F.lit(0.0)


def evidence_utility(summary: Column, partial: Column, chunks: Column, cut: Column) -> Column:
    """0.4 for a summary, 0.3 for a whole index, 0.2 for chunks or pages, less 0.2 for a cut or sampled text."""
    has = F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", 0.4).otherwise(0.0)
    whole = F.when(~partial, 0.3).otherwise(0.0)
    return has + whole + F.when(chunks > 0, 0.2).otherwise(0.0) - F.when(cut, 0.2).otherwise(0.0)


def scored(merged: DataFrame, utility: Column | None = None) -> DataFrame:
    """rrf, bucket and score = 1000 rrf + bonus + utility, rounded to four digits."""
    extra = F.lit(0.0) if utility is None else utility
    rows = merged.withColumn("rrf", rrf()).withColumn("bucket", bucket())
    return rows.withColumn("score", F.round(1000 * F.col("rrf") + overlap_bonus() + extra, 4))


def select_evidence(rows: DataFrame, limit: int, quotas: tuple = QUOTAS) -> DataFrame:
    """At most `limit` rows a query: each bucket's quota in rank order, then the best of the rest, in that order.

    Quotas are rounded half to even and are at least 1; the last bucket, semantic, has what is left of the limit.
    """
    takes = {name: max(1, round(share * limit)) for name, share in quotas} if limit > 1 else {quotas[0][0]: limit}
    takes["semantic"] = max(0, limit - sum(takes.values()))
    order = [F.col("score").desc(), F.col("rrf").desc(), "entry_id"]
    place = F.row_number().over(W.partitionBy("query_id", "bucket").orderBy(*order))
    table = F.create_map(*[F.lit(x) for kv in takes.items() for x in kv])
    group = F.create_map(*[F.lit(x) for i, n in enumerate(takes) for x in (n, i)])
    rows = rows.withColumn("_g", F.when(place <= F.coalesce(table[F.col("bucket")], F.lit(0)), group[F.col("bucket")]).otherwise(F.lit(len(takes))))
    final = F.row_number().over(W.partitionBy("query_id").orderBy("_g", *order))
    return rows.withColumn("place", final).filter(F.col("place") <= limit).drop("_g")


def rerank(rows: DataFrame, scores: DataFrame, window: int) -> DataFrame:
    """Reorders the first `window` rows of each query by outside scores; unscored ones sink to the window's end."""
    joined = rows.join(scores.select("query_id", "entry_id", F.col("score").alias("_r")), ["query_id", "entry_id"], "left")
    inside = F.col("place") <= window
    order = [(~inside).asc(), F.when(inside, F.col("_r")).desc_nulls_last(), "place"]
    return joined.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).drop("_r")


def note_validity(notes: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """id, entry_id and state of each entry that a note mentions: missing, entry_deleted, file_deleted, stale or ok."""
    e = entries.select("entry_id", "file_id", F.col("deleted_at").alias("_ed"), F.lit(True).alias("_e"))
    f = files.select("file_id", F.col("deleted_at").alias("_fd"), "ingested_at")
    rows = notes.join(e, "entry_id", "left").join(f, "file_id", "left")
    state = (
        F.when(F.col("_e").isNull(), "missing").when(F.col("_ed").isNotNull(), "entry_deleted").when(F.col("_fd").isNotNull(), "file_deleted").when(F.col("ingested_at") > F.col("noted_at"), "stale").otherwise("ok")
    )
    return rows.select("id", "entry_id", state.alias("state"))
