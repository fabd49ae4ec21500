"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, longest first. Queries first meet the bucket of the longest vectors,
which gives each a score to beat; then they meet, in blocks, those of the other buckets whose longest vector can reach
that score, and no other pair of bucket and block is shuffled. Inside a bucket the score to beat, divided
by the lengths, is a cosine: above 1 the bucket is skipped, a low one prunes by length (the bucket is sorted), a high
one prunes by the query's largest coordinate, where a candidate's must lie in a narrow range. What is left is verified
by whole integer products.

Defined cases: a vector that is null or holds null or non-finite components takes no part; shorter vectors count as
padded with zeros, an empty one scores 0; rows that share a query's id are its own; equal query rows are asked once;
every other row is a candidate, so a repeated one takes a rank for each time it is there; ties go to the smaller id;
an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.plans.columns import pick
from quern.plans.lineage import cut

SCALE = 256
#: Vectors in a bucket and queries in a block, about; vectors that share one score to beat.
BUCKET, BLOCK, STEP = 8192, 4096, 1024
#: Local cosines from which coordinates prune better than lengths.
COORDINATE_FROM = 0.6


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (whole components as doubles) and norm of the vectors that take part."""
    rows = pick(vectors, "vec_id", "embedding").filter("vec_id is not null and embedding is not null")
    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = rows.select("vec_id", x.alias("x")).filter(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))
    rows = rows.select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("double")).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    n = len(lists)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((n, width))
    flat = lists.flatten().to_numpy()
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _widest(table: pa.Table) -> int:
    return max((x or 0 for x in table.column("v").combine_chunks().value_lengths().to_pylist()), default=0)


def search_cell(vec_ids: np.ndarray, p: np.ndarray, query_ids: np.ndarray, q: np.ndarray, beat: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best of `p` for every query, less what can't reach its score to beat."""
    pn, qn = np.sqrt((p * p).sum(1)), np.sqrt((q * q).sum(1))
    order = np.lexsort((vec_ids, -pn))
    vec_ids, p, pn = vec_ids[order], p[order], pn[order]
    beat = beat.copy()
    wide = (pn.max(initial=0) * qn.max(initial=0)) >= 2.0**52  # beyond what doubles hold exactly
    unit_p, unit_q = p / np.maximum(pn, 1e-300)[:, None], q / np.maximum(qn, 1e-300)[:, None]
    focus = np.abs(unit_q).argmax(1) if q.shape[1] else np.zeros(len(q), int)
    best: list[list[tuple[int, int]]] = [[] for _ in q]

    def products(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        return of.astype(np.int64) @ rows.astype(np.int64).T if wide else of @ rows.T

    def offer(i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= beat[i]) & (ids != query_ids[i])
        ids, scores = ids[keep], scores[keep]
        if len(ids) > 4 * k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[scores >= least], scores[scores >= least]
        if len(ids):
            best[i] = sorted([*best[i], *((-int(s), int(v)) for s, v in zip(scores, ids))])[:k]
            if len(best[i]) == k:
                beat[i] = max(beat[i], -best[i][-1][0])

    for at in range(0, len(p), STEP):
        rows, ids, lengths = p[at : at + STEP], vec_ids[at : at + STEP], pn[at : at + STEP]
        reach = qn * lengths[0] * (1 + 1e-9) + 1e-6
        open_ = np.flatnonzero(reach >= beat)
        if not len(open_):
            break
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.where(qn[open_] * lengths[0] > 0, beat[open_] / (qn[open_] * lengths[0]), -1.0)
        sharp = cosine >= COORDINATE_FROM
        for part in np.array_split(open_[~sharp], max(1, ceil(len(open_) / 512))):
            if len(part):
                found = products(rows, q[part])
                for i, scores in zip(part, found):
                    n = len(lengths) if beat[i] <= 0 or not qn[i] else int(np.searchsorted(-lengths, -(beat[i] / qn[i]) * (1 - 1e-9), "right"))
                    offer(i, ids[:n], scores[:n])
        for i, c in zip(open_[sharp], np.minimum(cosine[sharp], 1.0)):
            x = unit_q[i, focus[i]]
            slack = np.sqrt(max(0.0, (1 - x * x) * (1 - c * c))) + 1e-7
            there = unit_p[at : at + STEP, focus[i]]
            # a vector of length l needs cosine c * longest / l or more, so the range for the longest is the widest
            mask = (there >= x * c - slack) if x >= 0 else (there <= x * c + slack)
            kept = np.flatnonzero(mask)
            if len(kept):
                offer(i, ids[kept], products(rows[kept], q[i : i + 1])[0])
    return [(int(query_ids[i]), v, -s) for i, found in enumerate(best) for s, v in found]


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            width = max(_widest(left), _widest(right))
            beat = right.column("beat").to_numpy().astype(float)
            found = search_cell(left.column("vec_id").to_numpy(), _matrix(left.column("v"), width), right.column("query_id").to_numpy(), _matrix(right.column("v"), width), beat, k)
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank int (from 1), vec_id and score long: each query's k largest integer inner products.

    `is_query` is a condition on vec_id. Runs jobs for the number of vectors and for the buckets, which are
    checkpointed in the shared folder.
    """
    whole = integer_vectors(vectors, scale)
    n, asked = whole.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    buckets, blocks = max(1, ceil(n / BUCKET)), max(1, ceil(asked / BLOCK))
    ranged = whole.repartitionByRange(buckets, F.col("norm").desc(), F.col("vec_id"))
    rows = cut(ranged.withColumn("bucket", F.spark_partition_id()))

    queries = rows.filter(is_query).select("vec_id", "v", "norm").distinct()
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    out = "query_id long, vec_id long, score long"

    def met(candidates: DataFrame, asking: DataFrame) -> DataFrame:
        asking = asking.select("vec_id", "v", "beat", "bucket", "block").toDF("query_id", "v", "beat", "at_bucket", "at_block")
        return candidates.groupBy("bucket", "block").cogroup(asking.groupBy("at_bucket", "at_block")).applyInArrow(_search(k), out)

    first = queries.withColumn("bucket", F.lit(0)).withColumn("beat", F.lit(float("-inf")))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    seeds = cut(met(rows.filter("bucket = 0").select("vec_id", "v", "bucket").withColumn("block", every), first))
    beats = seeds.groupBy(F.col("query_id").alias("_q")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("_beat"))

    # one row: a number for each bucket
    longest = rows.filter("bucket > 0").groupBy("bucket").agg(F.max("norm").alias("longest")).agg(F.collect_list(F.struct("bucket", "longest")).alias("_buckets"))
    asking = queries.join(beats, F.col("vec_id") == F.col("_q"), "left").withColumn("beat", F.coalesce("_beat", F.lit(float("-inf"))))
    reached = F.filter("_buckets", lambda b: b["longest"] * F.col("norm") * (1 + 1e-9) + 1e-6 >= F.col("beat"))
    asking = asking.crossJoin(F.broadcast(longest)).withColumn("bucket", F.explode(F.transform(reached, lambda b: b["bucket"])))
    wanted = asking.select(F.col("bucket").alias("_b"), "block").distinct()
    found = seeds.union(met(rows.select("vec_id", "v", "bucket").join(wanted, F.col("bucket") == F.col("_b")).drop("_b"), asking))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
