"""Best-fit packing with large-item matching, planned on a histogram.

Lengths lie between 1 and the capacity, so the number of pieces of each length says all that packing needs. The
plan is made from that histogram (at most `capacity` numbers, however large the corpus): pieces above a third of the
capacity are matched greedily, longest with the longest partner that fits, two to a bin at most; the rest go, longest
first, into the smallest remaining gap that holds them. The plan names ranges of sequences, and every piece finds its
own place from its rank among pieces of its length.

Defined cases: null and empty texts have the end token only; a repeated document is packed once per row; an empty
table gives no pieces; other columns are left behind unless carried.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.text import bounded, text_bytes
from quern.plans.columns import pick
from quern.plans.lineage import cut
from quern.plans.prefix import bucket_bits, running_total

CAPACITY = 4096
END_ID = 1
#: Words and parts of words whose ids a Python worker keeps; a table is dropped when full.
CACHE_WORDS, CACHE_PARTS = 500_000, 700_000

#: ASCII marks but the apostrophe, and lower-case ASCII and Latin-1 letters, as bytes.
_MARK, _LETTER = rb"[!-&(-/:-@\[-`{-~]", rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])"
#: Most words: letters with marks around them, which the tokenizer takes as up to three parts.
_SIMPLE = re.compile(rb"(%b*)(%b+)(%b*)|(%b+)" % (_MARK, _LETTER, _MARK, _MARK))
#: Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_KEPT = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHIFTED = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _KEPT)}


class _PartIds(dict):
    """Ids of lower-case runs of letters or of marks, by the tokenizer's own merge model."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, part: bytes) -> bytes:
        if len(self) >= CACHE_PARTS:
            self.clear()
        alphabet = part.decode("ascii") if part.isascii() else part.decode("latin-1").translate(_SHIFTED)
        ids = self[part] = _packed([t.id for t in self.model.tokenize(alphabet)])
        return ids


def _packed(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class WordIds(dict):
    """Ids of white-space separated words as little-endian uint32 bytes.

    The tokenizer drops white space and no token spans it, so a text's ids are its words' ids in a row. Simple words
    are split and lower-cased here and their parts kept; any other goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _PartIds(self.tokenizer.model)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        simple = _SIMPLE.fullmatch(word.lower())
        if simple and b"<|" not in word:
            ids = b"".join([self.parts[part] for part in simple.groups() if part])
        else:
            ids = _packed(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_tables: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's table for a tokenizer file; it outlives the task."""
    if path not in _tables:
        _tables[path] = WordIds(path)
    return _tables[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, carry: tuple[str, ...] = ("doc_id",), digest_only: bool = False) -> DataFrame:
    """Each document's ids, then `end_id`, cut after every `capacity` ids.

    Returns the carried columns, piece int, start long, length long, and ids array<int>, or with `digest_only`
    ids_crc32 long (of the little-endian unsigned 32-bit ids) in its place, so that shuffles needn't carry the ids.
    """
    source = pick(docs, *dict.fromkeys([*carry, "text"])).select(*carry, text_bytes().alias("_bytes"))
    types = dict(source.dtypes)
    last = "ids_crc32 long" if digest_only else "ids array<int>"
    out = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "piece int", "start long", "length long", last])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer)
        for batch in bounded(batches, "_bytes"):
            texts = batch.column("_bytes").to_pylist()
            rows, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(texts):
                data = table.encode(text) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4)
                    ids.append(zlib.crc32(part) if digest_only else part)
            if digest_only:
                tail = pa.array(ids, pa.int64())
            else:
                tail = pa.ListArray.from_arrays(pa.array([0, *accumulate(length)], pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            head = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*head, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), tail], names=[*carry, "piece", "start", "length", last.split()[0]])

    return source.mapInArrow(run, out)


class _Gaps:
    """Ranges of sequences by the room they have left."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.ranges:
                self.ranges[gap] = []
                insort(self.sizes, gap)
            self.ranges[gap].append((first, count))

    def smallest(self, least: int) -> tuple[int, int, int] | None:
        """Takes out one range of the smallest gap of `least` or more."""
        i = bisect_left(self.sizes, least)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, count = self.ranges[gap].pop()
        if not self.ranges[gap]:
            del self.ranges[gap], self.sizes[i]
        return gap, first, count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset): pieces of `length` by rank, to sequences in a row.

    Each entry puts one piece into each of a range of sequences. The number of entries depends on the capacity, not
    on the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths lie between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int]] = []
    gaps, sequences = _Gaps(), 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        steps.append((length, used[length], count, first, offset))
        used[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if n not in left:
            large.pop()
            continue
        at = bisect_left(large, capacity - n + 1) - 1
        while at >= 0 and (large[at] not in left or (large[at] == n and left[n] < 2)):
            if large[at] not in left:
                large.pop(at)
            at -= 1
        count = left[n]
        if at < 0:
            put(n, count, sequences, 0)
            gaps.add(capacity - n, sequences, count)
        else:
            m = large[at]
            count = left[n] // 2 if m == n else min(count, left[m])
            put(n, count, sequences, 0)
            put(m, count, sequences, n)
            gaps.add(capacity - n - m, sequences, count)
        sequences += count

    for n in sorted(left, reverse=True):
        while n in left:
            found = gaps.smallest(n)
            if found is None:
                each = capacity // n
                count = -(-left[n] // each)
                found = (capacity, sequences, count)
                sequences += count
            gap, first, count = found
            # all that fit of this length, one round over the range at a time
            while gap >= n and n in left and count:
                now = min(count, left[n])
                put(n, now, first, capacity - gap)
                gaps.add(gap, first + now, count - now)
                gap, count = gap - n, now
            gaps.add(gap, first, count)
    return steps


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 11) -> DataFrame:
    """`pieces` (any columns with a `length`) plus sequence_id long and offset long (gapless from 0).

    Runs one job for the histogram; pieces are checkpointed in the shared folder, as they are read twice.
    """
    if {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}:
        raise ValueError("pieces may not hold sequence_id or offset")
    spark = pieces.sparkSession
    pieces = cut(pieces.withColumn("_row", F.monotonically_increasing_id()))
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count(F.lit(1))).toLocalIterator()}
    steps = plan(histogram, capacity)

    bits = bucket_bits(sum(histogram.values()))
    rows = pieces.withColumn("_h", F.xxhash64(F.lit(seed), "_row"))
    ranked = running_total(rows, ["length"], "_h", ["_row"], F.lit(1), "_rank", bits)

    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for n, rank, _, first, offset in steps:
        by_length.setdefault(n, []).append((rank, first - rank, offset))
    table = {n: tuple(np.array(x, np.int64) for x in zip(*v)) for n, v in by_length.items()}
    shared = spark.sparkContext.broadcast(table)  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for n in np.unique(lengths):
                rank, shift, at = shared.value[int(n)]
                here = np.flatnonzero(lengths == n)
                k = np.searchsorted(rank, ranks[here], "right") - 1
                sequence[here], offset[here] = ranks[here] + shift[k], at[k]
            kept = [c for c in batch.schema.names if c not in ("_row", "_h", "_rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = [(n, t) for n, t in pieces.dtypes if n != "_row"]
    return ranked.mapInArrow(place, ", ".join([*(f"`{n}` {t}" for n, t in kept), "sequence_id long", "offset long"]))
