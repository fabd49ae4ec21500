"""Retrieval metrics from ranked lists (query_id, entry_id, place) and judgements (query_id, entry_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.quantiles import percentiles


def per_query(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """hit, recall, ndcg at k, reciprocal rank and counts, for every query with a positive judgement."""
    good = qrels.filter("rel > 0").select("query_id", "entry_id", "rel")
    judged = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.sort_array(F.collect_list("rel"), asc=False).alias("_ideal"))
    met = run.join(good, ["query_id", "entry_id"], "left")
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("place") + 1.0)
    inside = F.col("place") <= k
    found = met.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"),
        F.min(F.when(F.col("rel").isNotNull(), F.col("place"))).alias("first_rank"),
        F.count_if(inside & F.col("rel").isNotNull()).alias("hits"),
        F.sum(F.when(inside & F.col("rel").isNotNull(), gain).otherwise(0.0)).alias("_dcg"),
    )
    ideal = F.aggregate(F.slice("_ideal", 1, k), F.struct(F.lit(0.0).alias("s"), F.lit(1).alias("i")), lambda a, r: F.struct((a["s"] + (F.pow(F.lit(2.0), r) - 1) / F.log2(a["i"] + 1.0)).alias("s"), (a["i"] + 1).alias("i")))["s"]
    rows = judged.join(found, "query_id", "left").na.fill(0, ["returned", "hits"])
    return rows.select(
        "query_id", "relevant", "returned", F.col("first_rank"),
        (F.col("hits") > 0).cast("int").alias("hit"),
        F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"),
        F.round(F.coalesce(F.col("_dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"),
        F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """Means over queries, and the share of queries without results and without a hit."""
    return rows.agg(
        F.count(F.lit(1)).alias("queries"),
        *[F.round(F.avg(c), 6).alias(a) for c, a in (("hit", "hit_at_k"), ("recall", "recall_at_k"), ("ndcg", "ndcg_at_k"), ("reciprocal_rank", "mrr"))],
        F.round(F.avg((F.col("returned") == 0).cast("double")), 6).alias("zero_result_rate"),
        F.round(F.avg((F.col("hit") == 0).cast("double")), 6).alias("no_relevant_rate"),
    )


def ablation(runs: dict[str, DataFrame], qrels: DataFrame, k: int) -> DataFrame:
    """A row for each configuration, with differences from the first."""
    union = None
    for i, (name, run) in enumerate(runs.items()):
        row = summary(per_query(run, qrels, k)).select(F.lit(i).alias("position"), F.lit(name).alias("config"), "hit_at_k", "recall_at_k", "ndcg_at_k", "mrr")
        union = row if union is None else union.union(row)
    base = union.filter("position = 0").select(*[F.col(c).alias(f"_{c}") for c in ("hit_at_k", "recall_at_k", "ndcg_at_k", "mrr")])
    deltas = [F.round(F.col(c) - F.col(f"_{c}"), 6).alias(f"{c}_delta") for c in ("hit_at_k", "recall_at_k", "ndcg_at_k", "mrr")]
    return union.crossJoin(F.broadcast(base)).select("position", "config", "hit_at_k", "recall_at_k", "ndcg_at_k", "mrr", *deltas)  # one row


def latency(requests: DataFrame, group: list[str], limits: dict[str, float]) -> DataFrame:
    """p50, p95, p99 (linear between ranks), error rate, and whether any limit is passed."""
    p = percentiles(requests, group, "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(*group, *[F.round(n, 6).alias(n) for n in ("p50", "p95", "p99")])
    rows = requests.groupBy(*group).agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg(F.col("error").cast("double")), 6).alias("error_rate")).join(p, group, "left")
    broken = F.lit(0)
    for column, most in limits.items():
        broken = broken + (F.col(column) > most).cast("int")
    return rows.withColumn("violations", broken)
