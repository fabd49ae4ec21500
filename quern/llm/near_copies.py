"""Near copies by the share of five-word runs: SimHash balls and MinHash bands propose pairs, the texts themselves decide.

A text is the set of its runs of five lower-cased words. Texts with equal sets are joined first, by a 128-bit digest, so
that exact copies are never paired out. Every other text has a SimHash of its runs, and all whose fingerprints
are connected by balls (`simhash.links`) share a key; most near copies are farther apart than a ball reaches, so it has
BANDS keys of ROWS minima each besides. Texts that share a key are candidates, and only those whose similarity (common runs
divided by all runs of both) reaches 4/5 are linked. A pair at the threshold shares no band with a chance of 2.2e-5, one
at 0.9 with less than 1e-10. Classes are the connected components of the links.

Keys with the same texts are verified once. A key of many texts is dealt into parts of about CELL that meet two by two,
so that no task holds a whole group; inside a cell a text is compared until it is linked, so a group of copies costs
one comparison a text. Texts are read again only for candidates, which workers look up in sorted arrays in the shared
folder.

Defined cases: null texts count as empty and are copies of each other; fewer words than a run are one run; repeated rows
share a class; a null id comes first; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.licenses import _Hashes, shingle_hashes
from quern.llm.shared_files import map_array, write_array
from quern.llm.text import map_texts, text_bytes
from quern.operators.components import connected_components
from quern.plans.lineage import cut, fresh_dir
from quern.plans.rows import numbered

SHINGLE = 5
#: The least similarity, as a fraction of whole numbers.
NEAR = (4, 5)
BANDS, ROWS, SEED = 27, 5, 42
#: Texts of one part of a key, about, and runs whose minima are taken at a time.
CELL, BLOCK = 512, 1 << 12

_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes, table: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of words."""
    words = text.lower().split()
    return np.unique(shingle_hashes(words, min(SHINGLE, len(words)), table)) if words else np.zeros(0, np.uint64)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band, none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[at : at + BLOCK, None] ^ _XOR) * _TIMES).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for minima in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ minima) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the threshold; both empty counts as equal."""
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common * (NEAR[0] + NEAR[1]) >= NEAR[0] * (len(a) + len(b))


def links_within(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between near sets that connect all that are: a set is compared with each class until it joins it."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    classes: list[list[int]] = []
    out = []
    for i in order:
        least = len(sets[i]) * NEAR[0] / NEAR[1]
        joined, apart = [i], []
        for members in classes:
            # the longest come last; shorter ones than `least` can't be near, nor to anything later
            for j in reversed(members):
                if len(sets[j]) < least:
                    j = None
                    break
                if near(sets[i], sets[j]):
                    out.append((j, i))
                    break
            else:
                j = None
            if j is None:
                apart.append(members)
            else:
                joined = [*members, *joined]
        joined.sort(key=lambda k: len(sets[k]))
        classes = [m for m in apart if len(sets[m[-1]]) >= least] + [joined]
    return out


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, _row, the two halves of the digest of the set, its fingerprint and its keys."""
    table = _Hashes()

    def per_batch(texts: list[bytes]) -> dict[str, pa.Array]:
        from xxhash import xxh3_128_digest

        sets = [shingles(t, table) for t in texts]
        halves = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        keys = [band_keys(s) for s in sets]
        edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *keys])
        fp = np.fromiter((simhash.fingerprint(t, SHINGLE) for t in texts), np.uint64, len(texts)).view(np.int64)
        return {"high": pa.array(halves[:, 0]), "low": pa.array(halves[:, 1]), "fp": pa.array(fp), "keys": pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))}

    return map_texts(docs, ["doc_id", "_row"], "high long, low long, fp long, keys array<long>", per_batch)


def _candidate_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and _bytes of the rows whose number is among `nodes`, without a shuffle of texts."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "near")
    bits = ceil(log2(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def store(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        write_array(folder, f"node-{s}", np.unique(table.column("node").to_numpy()).astype("<i8"))
        return pa.table({"shard": pa.array([s], pa.int32())})

    sharded = nodes.select("node", F.pmod(F.col("node"), F.lit(1 << bits)).cast("int").alias("shard"))
    there = {r["shard"] for r in sharded.groupBy("shard").applyInArrow(store, "shard int").collect()}  # one number a shard

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, np.ndarray] = {}
        for batch in batches:
            node = batch.column(0).to_numpy()
            shard, hit = node & ((1 << bits) - 1), np.zeros(len(node), bool)
            for s in set(np.unique(shard).tolist()) & there:
                if s not in files:
                    files[s] = map_array(folder, f"node-{s}", "<i8")
                here = np.flatnonzero(shard == s)
                hit[here] = files[s][np.minimum(np.searchsorted(files[s], node[here]), len(files[s]) - 1)] == node[here]
            if hit.any():
                yield batch.filter(pa.array(hit))

    return docs.select(F.col("_row").alias("node"), text_bytes().alias("_bytes")).mapInArrow(among, "node long, _bytes binary")


def _ball_keys(distinct: DataFrame) -> DataFrame:
    """node and key: one key for all texts whose fingerprints are connected by balls."""
    classes = connected_components(simhash.links(distinct.select("fp").distinct())).toDF("_fp", "_class")  # only fingerprints that have a link
    named = distinct.join(classes, F.col("fp") == F.col("_fp"), "left")
    return named.select("node", F.xxhash64(F.coalesce("_class", "fp"), F.lit(SEED)).alias("key"))


def _links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of row numbers of near texts, which connect all that share a key."""
    keyed = distinct.select("node", F.explode("keys").alias("key")).union(cut(_ball_keys(distinct)))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("n > 1")
    shared = shared.groupBy("n", "x", "y").agg(F.min("key").alias("_key")).select("_key", "n")
    members = cut(keyed.join(shared, F.col("key") == F.col("_key")).select("node", "key", "n"))

    parts = F.ceil(F.col("n") / CELL).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("_parts")).cast("int")
    placed = members.withColumn("_parts", parts).withColumn("_mine", mine)
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    placed = placed.select("node", "key", F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"))
    texts = _candidate_texts(docs, members.select("node").distinct()).withColumnRenamed("node", "_node")

    def verify(table: pa.Table) -> pa.Table:
        hashes = _Hashes()
        node = table.column("node").to_numpy()
        found = links_within([shingles(t, hashes) for t in table.column("_bytes").to_pylist()])
        return pa.table({n: pa.array([node[p[k]] for p in found], pa.int64()) for k, n in enumerate("ab")})

    cells = placed.join(texts, F.col("node") == F.col("_node")).select("key", "i", "j", "node", "_bytes")
    return cells.groupBy("key", "i", "j").applyInArrow(verify, "a long, b long").distinct()


def keep_one(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """`columns` of one row of each class of near copies: the one with the smallest id (null first), then any of its rows."""
    docs = numbered(docs, *dict.fromkeys([*columns, "doc_id", "text"]))
    rows = cut(_signatures(docs))
    place = F.struct("doc_id", "_row")
    distinct = cut(rows.groupBy("high", "low").agg(F.min(place).alias("_place"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).select(F.col("_place._row").alias("node"), "_place", "fp", "keys"))
    classes = connected_components(_links(docs, distinct)).withColumnRenamed("node", "_n")  # only texts that have a link
    named = distinct.join(classes, F.col("node") == F.col("_n"), "left").select(F.coalesce("component", "node").alias("_class"), "_place")
    kept = named.groupBy("_class").agg(F.min("_place").alias("_first")).select("_first.*").toDF("_d", "_r")
    same = (F.col("_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    return docs.join(kept, same, "left_semi").select(*columns)
