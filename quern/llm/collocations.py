"""Phrase collocations by relational mining (SETM) over sorted occurrence relations.

The occurrences of phrases of one length are a relation (slice, piece, position, phrase) that is written, in order, to
the shared folder. A slice is some megabytes of text of one language; inside it phrases have small local numbers, a
relation is one array of them in order of pieces and positions, and -1 stands where nothing starts. A length costs

1. group-count: each slice sends the distinct phrases it has, with their counts, to buckets by hash;
2. semi-join: a bucket adds up and tells each slice which of its phrases are frequent, and by which id;
3. merge-join: in each slice, frequent phrases at neighbouring positions of a piece make the next length's occurrences.

A phrase of k + 1 words is known by the exact ids of its first and its last k words, so no hash stands for a phrase. Only
phrases that occur in a slice leave it, once each, whatever their number of occurrences: a word that a third of all
rows hold is a row for each slice. Buckets grow in number with the input, so each has a bounded share of all phrases.

Defined cases: a null text is empty, a null language is `und`; texts without words, and languages without candidates,
give no rows; repeated rows count as often as they are there; a very long text is a slice of its own, cut into words by
parts; ties in score are ordered by count, then by the phrase's bytes; an empty table gives no rows; other columns are
left behind.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.text import bounded, text_bytes
from quern.plans.columns import pick
from quern.plans.lineage import clear, stored, written

#: Bytes of text in a slice, and of text that is split into words at a time.
SLICE_BYTES, PART_BYTES = 4 << 20, 1 << 20
#: Occurrences for which there is a bucket, and the fewest buckets.
BUCKET_WORDS, LEAST_BUCKETS = 1 << 20, 64
#: Parts that rank their best phrases before a language's are ranked, and what is left of them by rounds.
RANK_PARTS = (512, 16, 1)

_BREAKS = bytes.maketrans(b".,;:!?\n\v\f\r\t", b"\n" * 10 + b" ")
_MARKS = "slice long, index binary, ids binary, id long, left long, right long, lang string, word binary, f long"
_MARK_NAMES = [c.strip().split(" ")[0] for c in _MARKS.split(",")]


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """Lower-case words in order, a line feed where a piece ends, and empty strings, by parts of a bounded size."""
    text = text.lower().translate(_BREAKS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PART_BYTES) if len(text) - at > PART_BYTES else -1
        end = len(text) if end < 0 else end
        yield text[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def _words(docs: DataFrame) -> DataFrame:
    """The occurrences of words: a row for each slice and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in bounded(batches, "_bytes", SLICE_BYTES):
            texts, langs = batch.column("_bytes"), defaultdict(list)
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                langs[lang].append(i)
            for lang, places in langs.items():
                local = defaultdict(int, {b"": 0, b"\n": 1})
                local.default_factory = local.__len__
                found = []
                for i in places:
                    for tokens in _tokens(texts[i].as_py()):
                        found.append(np.fromiter(map(local.__getitem__, tokens), np.int32, len(tokens)))
                    found.append(np.ones(1, np.int32))
                items = np.concatenate(found)
                items = items[items != 0] - 2
                counts = np.bincount(items[items >= 0], minlength=len(local) - 2)
                if len(counts):
                    yield pa.RecordBatch.from_pylist(
                        [{"slice": number, "lang": lang, "n": int(counts.sum()), "n_keys": len(counts), "items": items.tobytes(), "keys": b" ".join(list(local)[2:]), "counts": counts.astype(np.int32).tobytes()}], schema=schema
                    )
                    number += 1

    schema = pa.schema([("slice", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("n_keys", pa.int64()), ("items", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
    source = pick(docs, "text", "lang").select(F.coalesce("lang", F.lit("und")).alias("lang"), text_bytes().alias("_bytes"))
    return source.mapInArrow(run, "slice long, lang string, n long, n_keys long, items binary, keys binary, counts binary")


def _spread(values: np.ndarray) -> np.ndarray:
    """64-bit integers whose bits all depend on all bits of the values."""
    x = values.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, ends):
        if len(part):
            yield int(bucket[part[0]]), part


_SENT = "bucket long, slice long, lang string, index binary, keys binary, counts binary"
_SENT_TYPE = [("bucket", pa.int64()), ("slice", pa.int64()), ("lang", pa.string()), ("index", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())]


def _sent(words: DataFrame, buckets: int) -> DataFrame:
    """What slices send to buckets: numbers of words in the slice, the words and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, counts = row["keys"].split(b" "), np.frombuffer(row["counts"], np.int32)
                hashes = np.fromiter(map(zlib.crc32, keys), np.int64, len(keys))
                out = [
                    {"bucket": bucket, "slice": row["slice"], "lang": row["lang"], "index": part.astype(np.int32).tobytes(), "keys": b" ".join([keys[i] for i in part.tolist()]), "counts": counts[part].tobytes()}
                    for bucket, part in _by_bucket(hashes % buckets)
                ]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(_SENT_TYPE))

    return words.select("slice", "lang", "keys", "counts").mapInArrow(run, _SENT)


def _counted(sent: DataFrame, level: int, min_count: int, buckets: int, kind: str, tell: bool) -> DataFrame:
    """The frequent phrases (those with an id), and for each slice the numbers and ids of those it has.

    Frequent phrases of all buckets are numbered in turn, so ids are dense. `kind` is the type of the ids in keys.
    """

    def add_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        index = [np.frombuffer(r["index"], np.int32) for r in rows]
        counts = np.concatenate([np.frombuffer(r["counts"], np.int32) for r in rows]).astype(np.int64)
        if level == 1:
            known: dict[str, defaultdict] = {}
            numbers, names = [], []
            number = iter(range(len(counts))).__next__
            for r in rows:
                local = known.setdefault(r["lang"], defaultdict(number))
                words = r["keys"].split(b" ")
                numbers.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
            numbers = np.concatenate(numbers)
            names = {n: (lang, word) for lang, local in known.items() for word, n in local.items()}
            total = np.zeros(len(names), np.int64)
            np.add.at(total, numbers, counts)
        else:
            keys = np.concatenate([np.frombuffer(r["keys"], kind).reshape(2, -1) for r in rows], axis=1).astype(np.int64)
            order = np.lexsort(keys[::-1])
            ordered = keys[:, order]
            starts = np.flatnonzero(np.r_[True, (np.diff(ordered) != 0).any(axis=0)])
            numbers = np.empty(len(order), np.int64)
            numbers[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
            total = np.add.reduceat(counts[order], starts)
            unique = ordered[:, starts]
        out = {name: [] for name in _MARK_NAMES}

        def add(**values) -> None:
            for name in _MARK_NAMES:
                out[name].append(values.get(name))

        frequent = total >= min_count
        ids = (np.cumsum(frequent) - 1) * buckets + bucket
        for n in np.flatnonzero(frequent).tolist():
            if level == 1:
                add(id=int(ids[n]), f=int(total[n]), lang=names[n][0], word=names[n][1])
            else:
                add(id=int(ids[n]), f=int(total[n]), left=int(unique[0, n]), right=int(unique[1, n]))
        at = 0
        for r, places in zip(rows, index):
            own = numbers[at : at + len(places)]
            at += len(places)
            kept = frequent[own]
            if tell and kept.any():
                add(slice=r["slice"], index=places[kept].tobytes(), ids=ids[own[kept]].tobytes())
        return pa.table(out, schema=schema)

    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(c.strip().split(" ")[0], kinds[c.strip().split(" ")[1]]) for c in _MARKS.split(",")])
    return sent.groupBy("bucket").applyInArrow(add_up, _MARKS)


def _extended(relation: DataFrame, marks: DataFrame, buckets: int, kind: str, last: bool) -> DataFrame:
    """The occurrences one word longer, where frequent phrases are at neighbouring positions of a piece: what slices send to
    buckets, and unless phrases grow no longer a row for each slice (without a bucket) with the occurrences in order."""

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        row = left.to_pylist()[0]
        ids = np.full(row["n_keys"], -1, np.int64)
        for index, found in zip(right.column("index").to_pylist(), right.column("ids").to_pylist()):
            ids[np.frombuffer(index, np.int32)] = np.frombuffer(found, np.int64)
        items = np.frombuffer(row["items"], np.int32)
        keep = (items >= 0) & (ids[items] >= 0)
        at = np.flatnonzero(keep[:-1] & keep[1:])
        if not len(at):
            return schema.empty_table()
        pair = items[at].astype(np.int64) * row["n_keys"] + items[at + 1]
        unique, local, counts = np.unique(pair, return_inverse=True, return_counts=True)
        keys = np.stack([ids[unique // row["n_keys"]], ids[unique % row["n_keys"]]])
        hashes = _spread(_spread(keys[0]) + keys[1].astype(np.uint64))
        own = {"slice": row["slice"], "lang": row["lang"]}
        out = [
            own | {"bucket": bucket, "index": part.astype(np.int32).tobytes(), "keys": keys[:, part].astype(kind).tobytes(), "counts": counts[part].astype(np.int32).tobytes()}
            for bucket, part in _by_bucket((hashes % np.uint64(buckets)).astype(np.int64))
        ]
        if not last:
            longer = np.full(len(items), -1, np.int32)
            longer[at] = local
            longer = longer[(longer >= 0) | np.r_[False, longer[:-1] >= 0]]
            out.append(own | {"n_keys": len(unique), "items": longer.tobytes()})
        return pa.Table.from_pylist(out, schema=schema)

    schema = pa.schema([*_SENT_TYPE, ("n_keys", pa.int64()), ("items", pa.binary())])
    rows = relation.select("slice", "lang", "n_keys", "items").groupBy("slice").cogroup(marks.groupBy("slice"))
    return rows.applyInArrow(extend, _SENT + ", n_keys long, items binary")


def frequent_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """A table of frequent phrases for each length, and lang and n: all occurrences of words in it.

    Phrases have id, lang, phrase, f, left and right (ids of the phrases without their last and first word; null for
    words), and starts and ends: the counts of their first and last 1, 2, ... words.
    """
    spark = docs.sparkSession
    relation, folder = stored(_words(docs))
    before = folder
    totals = written(relation.groupBy("lang").agg(F.sum("n").alias("n")))
    levels: list[DataFrame] = []
    buckets = max(LEAST_BUCKETS, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS))
    sent, kind = _sent(relation, buckets), "<i8"
    for level in range(1, max_words + 1):
        marks = written(_counted(sent, level, min_count, buckets, kind, level < max_words))
        found = marks.filter("id IS NOT NULL")
        if level == 1:
            one = F.array("f")
            levels.append(found.select("id", "lang", F.col("word").cast("string").alias("phrase"), "f", "left", "right", one.alias("starts"), one.alias("ends")))
        else:
            shorter = levels[-1]
            first = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_head"), F.col("starts").alias("_starts"))
            rest = shorter.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("_word"), F.col("ends").alias("_ends"))
            rows = found.select("id", "f", "left", "right").join(first, "left").join(rest, "right")
            own = F.array("f")
            levels.append(
                written(rows.select("id", "lang", F.concat_ws(" ", "_head", "_word").alias("phrase"), "f", "left", "right", F.concat("_starts", own).alias("starts"), F.concat("_ends", own).alias("ends")))
            )
        if level < max_words:
            last = level + 1 == max_words
            # ids take four bytes while they can
            kind = "<u4" if (found.agg(F.max("id")).first()[0] or 0) < 1 << 32 else "<i8"
            made = _extended(relation, marks.filter("slice IS NOT NULL").select("slice", "index", "ids"), buckets, kind, last)
            before = folder
            if last:
                folder = None
            else:
                made, folder = stored(made)
                clear(spark, before)  # shorter occurrences are in the longer ones, as far as they matter
            relation, sent = made.filter("bucket IS NULL"), made.filter("bucket IS NOT NULL").select(*[n for n, _ in _SENT_TYPE])
        elif before:
            clear(spark, before)
    return levels, totals


def _cut(k: int, words: int) -> Column:
    """Score, place and parts of the cut after k words; exact, since the products are decimals of up to 38 digits."""
    score = F.expr(f"(CAST(f AS DECIMAL(15,0)) * CAST(f AS DECIMAL(15,0)) * 1000000BD) DIV (CAST(starts[{k - 1}] AS DECIMAL(15,0)) * CAST(ends[{words - k - 1}] AS DECIMAL(15,0)))")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(f"starts[{k - 1}]").alias("l"), F.expr(f"ends[{words - k - 1}]").alias("r"))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, cover_percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two words and more.

    A phrase's score is the least over its cuts in two, floor(1000000 a a / (l r)); it is dropped where a phrase of one
    more word holds it and has at least `cover_percent` of its occurrences. Counts fall with length, so a longer
    phrase that covers one has a part of one more word that covers it too.
    """
    levels, totals = frequent_phrases(docs, max_words, min_count)
    found = []
    for words, rows in enumerate(levels[1:], 2):
        if words < max_words:
            longer = levels[words]
            cover = longer.select(F.col("left").alias("id"), "f").union(longer.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("_longest"))
            rows = rows.join(cover, "id", "left").filter(F.col("_longest").isNull() | (100 * F.col("_longest").cast("decimal(19,0)") < cover_percent * F.col("f").cast("decimal(19,0)")))
        cuts = F.array(*[_cut(k, words) for k in range(1, words)])
        found.append(rows.select("lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("_cut")))
    rows = reduce(DataFrame.unionByName, found).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for parts in RANK_PARTS:
        ranked = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        rows = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*best))).filter(F.col("rank") <= top).drop("_part")
        rows = rows if parts == 1 else rows.drop("rank")
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
