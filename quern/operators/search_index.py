"""An inverted index as a table of blocks, and exact top-k search that reads only blocks able to change the result.

Entries are parted into ranges of `RANGE` rows that one task reads after one another. A block holds what one term has in one
range: ids, how often they hold it, and their lengths, so a range's blocks are made where its texts are read, and postings
aren't shuffled. A posting's share of a BM25 weight (all but the term's idf) doesn't depend on the query; an entry's score is
the sum of idf times share over the query's terms, and no entry of a range scores more than the sum of its blocks' largest. A search

1. adds up those bounds for each query and range, from the narrow table of the largest shares alone;
2. scores the few best ranges of each query; the k-th best score there is a floor for the k-th best of all;
3. scores the ranges whose bound reaches the floor, and leaves the blocks of all others unread.

Scoring brings a lane of ranges and a block of queries together in a cell. Of the index only blocks of asked terms move, once for
each block of queries; a cell passes on each query's k best entries, never a row for each posting of each query.

The index is written once (`build`) and opened by any number of searches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.retrieval import TOKEN
from quern.plans.lineage import fresh_dir, written

RANGE = 128
#: Ranges of a query that are scored to find a floor.
FIRST_RANGES = 8
#: Scores are rounded to six digits before they are compared, so a bound may be that much too low.
SLACK = 2e-6
#: Ranges of a lane and queries of a block that meet in one cell, about.
LANE, BLOCK = 64, 1024


def _blocks_of(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the texts (entry_id, _words) that a task reads, `size` rows a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                words = part.column("_words")
                of, said = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words).dictionary_encode()
                if not len(of):
                    continue
                code = said.indices.to_numpy().astype(np.int64)
                posting, tf = np.unique(code * part.num_rows + of, return_counts=True)
                row, code = posting % part.num_rows, posting // part.num_rows
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                ends = np.r_[first, len(code)]
                dl = np.bincount(of, minlength=part.num_rows)
                ids = part.column("entry_id").take(pa.array(row))
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), c) for c in (ids, pa.array(tf.astype(np.int32)), pa.array(dl[row].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(
                    [said.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), number)), pa.array(np.diff(ends)), *lists, pa.array(np.add.reduceat(tf, first).astype(np.int64))],
                    names=["term", "range", "n", "entries", "tf", "dl", "words"],
                )
                number += 1

    return run


@dataclass(frozen=True)
class Index:
    #: term, range, n, and of each posting entries array<long>, tf and dl array<int>.
    blocks: DataFrame
    #: term, range and top, the largest share of a block.
    tops: DataFrame
    #: term and idf.
    terms: DataFrame
    folder: str
    #: k1, b and the mean length, for shares.
    k1: float
    b: float
    mean: float


def _words(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)).alias("_words"))


def _share(tf, dl, k1: float, b: float, mean: float):
    """A weight without its idf, of Columns and of arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def build(texts: DataFrame, k1: float = 1.2, b: float = 0.75) -> Index:
    """Writes the index of `texts` (entry_id long, text), one row an entry. Texts without words count in the mean length alone, null ones only in idf."""
    spark, folder = texts.sparkSession, fresh_dir(texts.sparkSession, "index")
    words = _words(texts, "entry_id").select(F.col("entry_id").cast("long").alias("entry_id"), F.coalesce("_words", F.array().cast("array<string>")).alias("_words"))
    made = words.mapInArrow(_blocks_of(RANGE), "term string, range long, n long, entries array<long>, tf array<int>, dl array<int>, words long")
    made.write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema(made.schema).parquet(f"{folder}/blocks")
    n, told = texts.agg(F.count(F.lit(1)), F.count("text")).first()
    total = blocks.agg(F.sum("words")).first()[0] or 0
    mean = total / told if total else 1.0
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).write.parquet(f"{folder}/terms")
    top = F.array_max(F.zip_with("tf", "dl", lambda tf, dl: _share(tf, dl, k1, b, mean)))
    blocks.select("term", "range", top.alias("top")).write.parquet(f"{folder}/tops")
    spark.createDataFrame([(float(k1), float(b), float(mean))], "k1 double, b double, mean double").write.parquet(f"{folder}/about")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    blocks, tops, terms, about = (spark.read.parquet(f"{folder}/{n}") for n in ("blocks", "tops", "terms", "about"))
    return Index(blocks.drop("words"), tops, terms, folder, *about.select("k1", "b", "mean").first())


def _asked(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, term and idf of the terms that the index has."""
    asked = _words(queries, "query_id").select("query_id", F.explode(F.array_distinct("_words")).alias("term")).distinct()
    return asked.join(index.terms, "term").select("query_id", "term", "idf")


def _scored(index: Index, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best entries of each query in a cell: blocks of a lane on the left; on the right what queries ask (term and idf) and
    which ranges they want."""
    k1, b, mean = index.k1, index.b, index.mean

    def cell(blocks: pa.Table, right: pa.Table) -> pa.Table:
        queries, entries, scores = [], [], []
        kind = right.schema.field("query_id").type
        if blocks.num_rows and right.num_rows:
            array = lambda c: c.combine_chunks().to_numpy(zero_copy_only=False)
            terms = pc.unique(blocks.column("term"))
            code = array(pc.index_in(blocks.column("term"), value_set=terms))
            order = np.argsort(code, kind="stable")
            blocks, code = blocks.take(pa.array(order)), code[order]
            edges = np.searchsorted(code, np.arange(len(terms) + 1))
            spans, span = np.unique(array(blocks.column("range")), return_inverse=True)
            n = array(pc.list_value_length(blocks.column("entries"))).astype(np.int64)
            starts = np.cumsum(n) - n
            flat = lambda c: array(pc.list_flatten(blocks.column(c)))
            ids, at = np.unique(flat("entries"), return_inverse=True)
            share = _share(flat("tf").astype(np.float64), flat("dl"), k1, b, mean)
            asks = right.filter(pc.is_valid(right.column("term"))).select(["query_id", "term", "idf"]).sort_by([("query_id", "ascending"), ("term", "ascending")])
            wants = right.filter(pc.is_valid(right.column("range"))).select(["query_id", "range"])
            who = pc.unique(asks.column("query_id"))
            asker, term = array(pc.index_in(asks.column("query_id"), value_set=who)), array(pc.fill_null(pc.index_in(asks.column("term"), value_set=terms), -1))
            idf, limits = array(asks.column("idf")), np.searchsorted(asker, np.arange(len(who) + 1))
            wanted = np.zeros((len(who), len(spans)), bool)
            by, of = array(pc.fill_null(pc.index_in(wants.column("query_id"), value_set=who), -1)), array(wants.column("range"))
            place = np.minimum(np.searchsorted(spans, of), len(spans) - 1)
            met = (by >= 0) & (spans[place] == of)
            wanted[by[met], place[met]] = True
            for q, (i, j) in enumerate(zip(limits, limits[1:])):
                known = np.flatnonzero(term[i:j] >= 0) + i
                m = edges[term[known] + 1] - edges[term[known]]
                rows = np.repeat(edges[term[known]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                value = np.repeat(idf[known], m)
                inside = wanted[q, span[rows]]
                rows, value = rows[inside], value[inside]
                m = n[rows]
                posting = np.repeat(starts[rows] - np.cumsum(m) + m, m) + np.arange(m.sum())
                total = np.bincount(at[posting], np.repeat(value, m) * share[posting], len(ids))
                hit = np.flatnonzero(total)
                total = np.round(total[hit], 6)
                # entries are in order of id, and the sort is stable: ties go to the smaller
                best = np.argsort(-total, kind="stable")[:k]
                queries += [who[q].as_py()] * len(best)
                entries.append(ids[hit[best]])
                scores.append(total[best])
        joined = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        return pa.table({"query_id": pa.array(queries, kind), "entry_id": joined(entries, pa.int64()), "score": joined(scores, pa.float64())})

    return cell


def _scores(asked: DataFrame, index: Index, ranges: DataFrame, k: int) -> DataFrame:
    """query_id, entry_id and score of the best entries of the named ranges (query_id, range), k of each lane."""
    lanes = max(1, ceil(ranges.select("range").distinct().count() / LANE))
    blocks = max(1, ceil(asked.select("query_id").distinct().count() / BLOCK))
    # both sides have keys of one type: a cogroup deals each side by the hash of its own type
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = index.blocks.join(asked.select("term").distinct(), "term", "left_semi").join(ranges.select("range").distinct(), "range", "left_semi")
    left = met.select(part("range", lanes).alias("lane"), every(blocks).alias("block"), "term", "range", "entries", "tf", "dl")
    asks = asked.select("query_id", "term", "idf", F.lit(None).cast("long").alias("range"), every(lanes).alias("_lane"))
    wants = ranges.select("query_id", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("idf"), "range", part("range", lanes).alias("_lane"))
    right = asks.unionByName(wants).withColumn("_block", part("query_id", blocks))
    met = left.groupBy("lane", "block").cogroup(right.groupBy("_lane", "_block"))
    return met.applyInArrow(_scored(index, k), f"query_id {dict(asked.dtypes)['query_id']}, entry_id long, score double")


def _best(scores: DataFrame, k: int, rank: str) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "entry_id")
    return scores.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


@dataclass(frozen=True)
class Search:
    #: query_id, entry_id, score and rank of the k best entries that share a term; ties go to the smaller id.
    results: DataFrame
    #: query_id, range, blocks (those of the query's terms in the range) and read, whether they were read.
    ranges: DataFrame


def search(index: Index, queries: DataFrame, k: int, rank: str = "rank") -> Search:
    """The k best entries for each query (query_id, text), the same as of scoring every entry."""
    asked = written(_asked(queries, index))
    bounds = asked.join(index.tops, "term").groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"), F.count(F.lit(1)).alias("blocks"))
    bounds = written(bounds)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("bound").desc(), "range"))
    first = written(bounds.withColumn("_n", place).filter(F.col("_n") <= FIRST_RANGES).select("query_id", "range"))
    found = written(_best(_scores(asked, index, first, k), k, "_n"))
    floors = found.filter(F.col("_n") == k).select("query_id", F.col("score").alias("_floor"))
    rest = bounds.join(first, ["query_id", "range"], "left_anti").join(floors, "query_id", "left").filter(F.col("_floor").isNull() | (F.col("bound") >= F.col("_floor") - SLACK))
    rest = written(rest.select("query_id", "range"))
    results = _best(found.drop("_n").unionByName(_scores(asked, index, rest, k)), k, rank)
    read = first.union(rest).withColumn("_r", F.lit(True))
    ranges = bounds.join(read, ["query_id", "range"], "left").select("query_id", "range", "blocks", F.coalesce("_r", F.lit(False)).alias("read"))
    return Search(results, ranges)
