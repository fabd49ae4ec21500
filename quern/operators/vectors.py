"""Vector search by dot product, exact."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Records in a lane and queries in a block, about.
LANE, BLOCK = 8192, 1024


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def _cells(records: DataFrame, queries: DataFrame, columns: list[str]):
    """Records and queries grouped so that each lane of entries meets each block of queries once, and their types."""
    records, queries = records.filter("vector IS NOT NULL"), queries.filter("query IS NOT NULL")
    lanes, blocks = max(1, ceil(records.count() / LANE)), max(1, ceil(queries.count() / BLOCK))
    # both sides have keys of one type: a cogroup deals each side by the hash of its own type, and an int's isn't a long's
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    lane, block = part("entry_id", lanes), part("query_id", blocks)
    left = records.select(*columns, "vector", lane.alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("query_id", "query", block.alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_lane"))
    return left.groupBy("block", "lane").cogroup(right.groupBy("_block", "_lane")), dict(left.dtypes) | dict(right.dtypes)


def search(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, entry_id, score, rank: the k best entries of each query, an entry by its best record.

    Queries (query_id, query) and records (entry_id, vector) meet in cells of bounded size: a lane of entries by a block
    of queries. A cell multiplies two matrices and passes on the k best entries of each query. Rows with a null vector
    are left out; all vectors have one length.
    """
    met, types = _cells(records, queries, ["entry_id"])

    def cell(r: pa.Table, q: pa.Table) -> pa.Table:
        out = ([], [], [])
        if r.num_rows and q.num_rows:
            r = r.sort_by("entry_id")
            rows, asked = (np.stack(t.column(c).to_numpy()).astype(np.float64) for t, c in ((r, "vector"), (q, "query")))
            ids = r.column("entry_id").to_pylist()
            starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
            best = np.round(np.maximum.reduceat(asked @ rows.T, starts, axis=1), 6)
            for query_id, scores in zip(q.column("query_id").to_pylist(), best):
                # entries are in order of id, and the sort is stable: ties go to the smaller
                for i in np.argsort(-scores, kind="stable")[:k]:
                    for column, value in zip(out, (query_id, ids[starts[i]], float(scores[i]))):
                        column.append(value)
        return pa.table({"query_id": pa.array(out[0], q.schema.field("query_id").type), "entry_id": pa.array(out[1], r.schema.field("entry_id").type), "score": pa.array(out[2], pa.float64())})

    found = met.applyInArrow(cell, f"query_id {types['query_id']}, entry_id {types['entry_id']}, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "entry_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def best_sections(records: DataFrame, queries: DataFrame, least: float = 0.45) -> DataFrame:
    """query_id, entry_id, section_id and score: each entry's best section for each query, where it reaches the threshold.

    `records` has entry_id, section_id and vector. Cells pass on only what reaches the threshold; of equal scores the
    last section by name is taken.
    """
    met, types = _cells(records, queries, ["entry_id", "section_id"])

    def cell(r: pa.Table, q: pa.Table) -> pa.Table:
        at, of, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if r.num_rows and q.num_rows:
            rows, asked = (np.stack(t.column(c).to_numpy()).astype(np.float64) for t, c in ((r, "vector"), (q, "query")))
            product = np.round(asked @ rows.T, 6)
            of, at = np.nonzero(product >= least)
            scores = product[of, at]
        found = r.select(["entry_id", "section_id"]).take(pa.array(at))
        return pa.table({"query_id": q.column("query_id").take(pa.array(of)), "entry_id": found.column(0), "section_id": found.column(1), "score": pa.array(scores)})

    found = met.applyInArrow(cell, f"query_id {types['query_id']}, entry_id {types['entry_id']}, section_id {types['section_id']}, score double")
    best = found.groupBy("query_id", "entry_id").agg(F.max(F.struct("score", "section_id")).alias("_b"))
    return best.select("query_id", "entry_id", F.col("_b.section_id").alias("section_id"), F.col("_b.score").alias("score"))


def refresh(index: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, to embed): records whose text is known keep their vector, by content hash; the others are to be made."""
    known = index.groupBy("text_hash").agg(F.first("vector").alias("vector"))
    return current.join(known, "text_hash"), current.join(known, "text_hash", "left_anti")
