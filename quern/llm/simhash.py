"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit set where more than half of a document's shingle hashes have it. Two fingerprints at most
`radius` bits apart share a variant at most half the radius away from each, so every distinct fingerprint emits all
its variants, the variants are shuffled, and those that collide are linked. Equal fingerprints are joined before
anything is emitted, and a variant can only come from the fingerprints around it: 65 at most for radius 2, however
many copies there are. All of them lie within the radius of each other, so a link to the smallest of them carries the
group, and no group is paired out.

Defined cases: null texts count as empty and have fingerprint zero, which links like any other; fewer words than a
shingle are hashed whole; repeated rows share a class; a null id has a class but never names it, unless all ids in
the class are null; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.text import map_texts
from quern.operators.components import connected_components
from quern.plans.lineage import cut
from quern.plans.rows import numbered

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Hashes whose bits are counted at a time, and fingerprints whose variants one task emits.
BLOCK, EMITTED = 1 << 14, 50_000


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of the lower-cased words of `text`, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - size + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The carried columns and the fingerprint as a signed long."""

    def per_batch(texts: list[bytes]) -> dict[str, pa.Array]:
        found = np.fromiter((fingerprint(t, size, seed) for t in texts), np.uint64, len(texts))
        return {"fp": pa.array(found.view(np.int64))}

    return map_texts(docs, list(carry), "fp long", per_batch)


def ball(radius: int) -> list[int]:
    """Signed masks of up to `radius` bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in `fp`, at most `radius` bits apart, that connect all that are.

    The radius is even; half of it is the reach of a variant.
    """
    if radius % 2:
        raise ValueError("the radius is even")
    # few partitions hold the fingerprints, but not what they emit
    spread = distinct.repartition(max(1, ceil(distinct.count() / EMITTED)), "fp")
    variants = spread.select("fp", F.explode(F.array(*[F.lit(m) for m in ball(radius // 2)])).alias("_m"))
    variants = variants.select("fp", F.col("fp").bitwiseXOR(F.col("_m")).alias("_v"))
    smallest = F.min("fp").over(W.partitionBy("_v"))
    pairs = variants.select(smallest.alias("a"), F.col("fp").alias("b")).filter("a < b")
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def _named(rows: DataFrame, least: str, radius: int) -> DataFrame:
    """_f and `first`: each distinct fingerprint of `rows` and the smallest `least` of its class."""
    distinct = cut(rows.groupBy("fp").agg(F.min(least).alias("_least")))
    classes = connected_components(links(distinct.select("fp"), radius))  # only fingerprints that have a link
    named = distinct.join(classes, distinct["fp"] == classes["node"], "left").select("fp", "_least", F.coalesce("component", "fp").alias("_class"))
    firsts = named.groupBy("_class").agg(F.min("_least").alias("first"))
    return named.join(firsts, "_class").select(F.col("fp").alias("_f"), "first")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits) and component_id of every document."""
    rows = cut(fingerprints(docs, ("doc_id",), size, seed))
    named = _named(rows, "doc_id", radius)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, rows["fp"] == named["_f"]).select("doc_id", hexed.alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, columns: tuple[str, ...], radius: int = RADIUS, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """`columns` of one row of each class: the one with the smallest id (null first), then any one of its rows."""
    docs = numbered(docs, *dict.fromkeys([*columns, "doc_id", "text"]))
    rows = cut(fingerprints(docs, ("doc_id", "_row"), size, seed)).withColumn("_place", F.struct("doc_id", "_row"))
    kept = _named(rows, "_place", radius).select("first.*").distinct().toDF("_d", "_r")
    same = (F.col("_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    return docs.join(kept, same, "left_semi").select(*columns)
