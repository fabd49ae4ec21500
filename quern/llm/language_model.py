"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped sorted hash arrays.

Learning reads the texts twice. The first pass counts words: each task sends hashes and counts to the shard that the
high bits name, which writes a sorted hash array with counts; a word's id is its place in those arrays. The second
counts runs of `order` ids: each task sends its distinct runs, sorted and packed, to shards that add them up and write
a sorted hash array with counts. A shard then sends on what the next lower order needs: how many runs end in each
shorter run, and the sum and the small counts of the runs that begin with it. So it goes down to single words, an order
a shuffle, each with fewer rows than the one before. Runs are sharded by their first word, and those of a frequent word
are dealt by the other words too, so a shard's size doesn't depend on any one word or context. Scoring is a third pass,
without a shuffle: workers map the arrays and look up the distinct runs of each slice of text.

Tokens are lower-cased words and one end per text; ends also stand before the first word. Unknown words share the
weight that the lowest order leaves to them. Ids take 32 bits: up to four billion distinct words. In an array a run is
known by its bucket, about four runs by the high bits of its hash, and 32 further bits: one lookup in a billion may take
a run never seen for one that was. Words are known by all 64 bits.

Defined cases: null texts count as empty and have the end token only; a null id is learned from; repeated rows count
each time; a text of any length is one text, taken in slices of many texts or one; without any row to learn from every
score is 0; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared_files import Kept, map_array, write_array
from quern.llm.text import map_texts, text_bytes
from quern.plans.columns import pick
from quern.plans.lineage import fresh_dir

#: No word holds white space, so this one stands for the end of a text.
END = b"\n"
ORDER = 3
#: Bytes of text that are turned into ids at a time, words and tokens that are added up at a time.
SLICE, COUNTED, SORTED = 4 << 20, 500_000, 2_500_000
#: Training tokens for each shard of runs, and bytes of training text for each shard of words.
SHARD_TOKENS, SHARD_BYTES = 2_000_000, 32 << 20
#: Runs of a bucket, about.
BUCKET = 4
#: Files of words, and shards of runs (four files each), that a worker holds open at most: under 1024 files with its own.
OPEN_WORDS, OPEN_RUNS = 128, 180
LOW = np.uint64(0xFFFFFFFF)
#: What an array knows of a run: how many runs one longer end in it, and of those that begin with it the sum and how
#: many are counted once, twice, and more often.
STATS = ("<u4", "<u8", "<u4", "<u4", "<u4")


def _hash(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _split(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The distinct lower-cased words of some texts, each word's place among them, and how many words a text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    coded = pc.dictionary_encode(lists.flatten())
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.view(pa.binary()).to_pylist()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    # blanks at either end, or nothing else, leave an empty word
    if b"" in words:
        blank = words.index(b"")
        inside = codes != blank
        sizes = np.add.reduceat(inside.astype(np.int64), np.cumsum(sizes) - sizes)
        codes = codes[inside]
        codes[codes > blank] -= 1
        del words[blank]
    return codes, words, sizes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(16)


def _longer(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hashes of runs, each one id longer than those with hashes `h`."""
    h = (h ^ (ids.astype(np.uint64) + np.uint64(1))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _run_hash(columns: list[np.ndarray], n: int) -> np.ndarray:
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for ids in columns:
        h = _longer(h, ids)
    return h


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts whole numbers, where each distinct one starts in it, and the distinct ones."""
    bits = np.uint64(max(1, len(keys) - 1).bit_length())
    if len(keys) and int(keys.max()) < 1 << (64 - int(bits)):
        # number and place in one, which sorts several times faster
        packed = np.sort(keys.astype(np.uint64) << bits | np.arange(len(keys), dtype=np.uint64))
        order, found = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), packed >> bits
    else:
        order = np.argsort(keys, kind="stable")
        found = keys[order].astype(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])[: len(keys)])
    return order, starts, found[starts]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's place among them, and a place in `keys` of each."""
    order, starts, distinct = _groups(keys)
    step = np.zeros(len(keys), np.int64)
    step[starts] = 1
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(step) - 1
    return distinct, rank, order[starts]


def _pairs(rank: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """A number for each run, from the rank of its beginning and its last word's, which is below `width`."""
    return rank.astype(np.uint64) * np.uint64(max(1, width)) + last.astype(np.uint64)


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place among the distinct ones, and those; most values are small."""
    if len(x) and int(x.max()) < 4 * len(x) + 1024:
        there = np.bincount(x.astype(np.int64)) > 0
        return (np.cumsum(there) - 1)[x.astype(np.int64)], np.flatnonzero(there).astype(np.uint64)
    distinct, rank, _ = _ranked(x)
    return rank, distinct


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers as compressed planes of bytes; the first is sorted and goes as differences."""
    import zstandard

    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(raw: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(planes) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return [np.cumsum(out[0], dtype=out[0].dtype), *out[1:]]


def _together(blocks: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    parts = [_unpack(b, kinds) for b in blocks if b]
    return [np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds)]


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts shards together and changes nothing inside them, and the edges between them."""
    shard = shard.astype(np.uint16) if shards <= 1 << 16 else shard
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _dealt(shard: np.ndarray, shards: int, columns: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """The shards named, and the packed rows of each in the order given."""
    order, edges = _by_shard(shard, shards)
    named = np.flatnonzero(np.diff(edges)).tolist()
    return named, [_pack([c[order[edges[s] : edges[s + 1]]] for c in columns]) for s in named]


def _every_shard(rows: DataFrame, shards: int) -> DataFrame:
    """The rows and an empty one for each shard, so that each writes its arrays."""
    nothing = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), *[F.lit(None).cast(t).alias(n) for n, t in rows.dtypes[1:]])
    return rows.union(nothing)


@dataclass
class Vocabulary:
    """Sorted hash arrays of words and counts by rank, a few files a shard. An id is rank * shards + shard."""

    folder: str
    bits: int
    #: Words in each shard.
    sizes: list[int]
    tokens: int
    _files: Kept = field(default_factory=lambda: Kept(OPEN_WORDS), repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_files": Kept(self._files.most)}

    @property
    def types(self) -> int:
        return sum(self.sizes)

    @property
    def unknown(self) -> int:
        """The id of all words that aren't known."""
        return max(self.sizes) << self.bits

    def _file(self, name: str, kind: str) -> np.ndarray:
        return self._files.of(name, lambda: map_array(self.folder, name, kind))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Ids of words by binary search."""
        h = _hash(words)
        ids = np.full(len(h), self.unknown, np.uint32)
        order, edges = _by_shard((h >> np.uint64(64 - self.bits)).astype(np.int64), 1 << self.bits)
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if self.sizes[s]:
                here = order[edges[s] : edges[s + 1]]
                table = self._file(f"word-{s}.hash", "<u8")
                at = np.minimum(np.searchsorted(table, h[here]), len(table) - 1)
                hit = table[at] == h[here]
                ids[here[hit]] = (self._file(f"word-{s}.rank", "<u4")[at[hit]] << np.uint32(self.bits)) + np.uint32(s)
        return ids

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts by id; 0 for the unknown."""
        out = np.zeros(len(ids), np.int64)
        rank, shard = (ids >> np.uint32(self.bits)).astype(np.int64), (ids & np.uint32((1 << self.bits) - 1)).astype(np.int64)
        order, edges = _by_shard(shard, 1 << self.bits)
        for s in np.flatnonzero(np.diff(edges)).tolist():
            here = order[edges[s] : edges[s + 1]]
            here = here[rank[here] < self.sizes[s]]
            if len(here):
                # counts fall with the rank: the table has where each one ends
                ends, value = self._file(f"word-{s}.counts", "<u8").reshape(2, -1)
                out[here] = value[np.searchsorted(ends, rank[here].astype(np.uint64), "right")]
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all tokens of several texts in a list of ids, that list with the end last, tokens of each text."""
        codes, words, sizes = _split(texts)
        sizes = sizes + 1
        out = np.full(int(sizes.sum()), len(words), np.int64)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(sizes) - 1] = False
        out[inside] = codes
        return out, self.find([*words, END]), sizes


def _padded(tokens: np.ndarray, sizes: np.ndarray, end: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with `more` ends before each text, and where they are."""
    at = np.arange(len(tokens)) + np.repeat(np.arange(1, len(sizes) + 1) * more, sizes)
    out = np.full(len(tokens) + more * len(sizes), end, tokens.dtype)
    out[at] = tokens
    return out, at


def _added(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their counts in all."""
    order, starts, words = _groups(h)
    return words, np.add.reduceat(c[order], starts) if len(h) else c


def count_words(texts: DataFrame, folder: str, bits: int) -> Vocabulary:
    """First pass over `_bytes` of the training texts: writes the vocabulary."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            h, c = _added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            named, blocks = _dealt((h >> np.uint64(64 - bits)).astype(np.int64), 1 << bits, [h, c])
            return pa.RecordBatch.from_arrays([pa.array(named, pa.int32()), pa.array(blocks, pa.binary())], names=["shard", "block"])

        parts, held = [], 0
        for batch in batches:
            for part in _slices(batch.column(0).to_pylist()):
                codes, words, sizes = _split(part)
                parts.append((_hash([*words, END]), np.append(np.bincount(codes, minlength=len(words)), len(sizes)).astype(np.uint64)))
                held += len(words)
                if held > COUNTED:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    def merge(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        h, counts = _added(*_together(table.column("block").to_pylist(), ("<u8", "<u8")))
        by_count = np.argsort(~counts, kind="stable")
        rank = np.empty(len(h), "<u4")
        rank[by_count] = np.arange(len(h), dtype=np.uint32)
        falling = counts[by_count]
        ends = np.flatnonzero(np.append(falling[1:] != falling[:-1], True)[: len(h)])
        write_array(folder, f"word-{s}.hash", h.astype("<u8"))
        write_array(folder, f"word-{s}.rank", rank)
        write_array(folder, f"word-{s}.counts", np.concatenate([ends.astype("<u8") + np.uint64(1), falling[ends].astype("<u8")]))
        return pa.table({"shard": pa.array([s], pa.int32()), "types": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    shards = texts.mapInArrow(local, "shard int, block binary").groupBy("shard").applyInArrow(merge, "shard int, types long, tokens long").collect()
    sizes = [0] * (1 << bits)  # one number a shard
    for r in shards:
        sizes[r["shard"]] = r["types"]
    return Vocabulary(folder, bits, sizes, sum(r["tokens"] for r in shards))


@dataclass
class RunShards:
    vocabulary: Vocabulary
    shards: int

    def fan(self, counts: np.ndarray) -> np.ndarray:
        """Over how many shards the runs of a first word with so many tokens are dealt."""
        share = (counts * self.shards // max(1, self.vocabulary.tokens)).astype(np.uint64)
        return np.minimum(share * np.uint64(4) + np.uint64(1), np.uint64(self.shards))

    def of(self, first: np.ndarray, fan: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The shard of each run, from its first word and the hash of the others."""
        return ((_mixed(first) + _mixed(rest) % fan) % np.uint64(self.shards)).astype(np.int32)

    def of_runs(self, columns: list[np.ndarray]) -> np.ndarray:
        words, rank, _ = _ranked(columns[0])
        return self.of(columns[0], self.fan(self.vocabulary.counts(words.astype(np.uint32)))[rank], _run_hash(columns[1:], len(rank)))


def _rows(columns: list[np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted runs ready to be packed: the first two ids as one number, further ids, values."""
    head = columns[0].astype(np.uint64)
    if len(columns) > 1:
        head = head << np.uint64(32) | columns[1].astype(np.uint64)
    return [head, *(c.astype("<u4") for c in columns[2:]), *values]


def _ids(rows: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The columns of ids of unpacked rows."""
    head = rows[0]
    return [head.astype(np.uint32)] if length == 1 else [(head >> np.uint64(32)).astype(np.uint32), (head & LOW).astype(np.uint32), *rows[1 : length - 1]]


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts runs by their ids, and where each distinct one starts in it."""
    n = len(columns[0])
    words, ranks, _ = _ranked(np.concatenate(columns))
    rank, *others = (ranks[i * n : (i + 1) * n] for i in range(len(columns)))
    for i, last in enumerate(others):
        key = _pairs(rank, last, len(words))
        if i == len(others) - 1:
            return _groups(key)[:2]
        rank = _ranked(key)[1]
    return _groups(rank)[:2]


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


def _beginnings(columns: list[np.ndarray], a: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What sorted distinct runs with counts `a` say of those that they begin with: ids and STATS."""
    change = np.zeros(max(0, len(a) - 1), bool)
    for c in columns[:-1]:
        change |= c[1:] != c[:-1]
    starts = np.flatnonzero(np.concatenate([[True], change])[: len(a)])
    stats = [np.zeros(len(starts)), _sums(a, starts), _sums(a == 1, starts), _sums(a == 2, starts), _sums(a > 2, starts)]
    return [c[starts] for c in columns[:-1]], [x.astype(k) for x, k in zip(stats, STATS)]


def _endings(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """How many of the distinct runs end in each one shorter: ids and STATS."""
    order, starts = _grouped(columns[1:])
    n = np.diff(np.append(starts, len(order)))
    return [c[order[starts]] for c in columns[1:]], [n.astype(STATS[0]), *(np.zeros(len(n), k) for k in STATS[1:])]


def _write_runs(folder: str, name: str, h: np.ndarray, records: list[np.ndarray]) -> None:
    """Hashes by bucket, where buckets start, and for each run the place of its record among the distinct ones."""
    bits = max(1, (len(h) // BUCKET).bit_length())
    order = _groups(h >> np.uint64(64 - bits))[0]
    starts = np.searchsorted(h[order] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    code = np.zeros(len(h), np.int64)
    values: list[np.ndarray] = []
    for column in records:
        rank, distinct = _coded(column)
        code, found = _coded(_pairs(code, rank, len(distinct)))
        known = (found // np.uint64(max(1, len(distinct)))).astype(np.int64)
        values = [*(v[known] for v in values), distinct[(found % np.uint64(max(1, len(distinct)))).astype(np.int64)]]
    kind = "<u1" if len(values[0]) <= 1 << 8 else "<u2" if len(values[0]) <= 1 << 16 else "<u4"
    write_array(folder, f"{name}.key", (h[order] & LOW).astype("<u4"))
    write_array(folder, f"{name}.start", starts.astype("<u4"))
    write_array(folder, f"{name}.code", code[order].astype(kind))
    write_array(folder, f"{name}.record", np.stack(values, axis=1).astype("<u8"))


@dataclass
class KneserNey:
    """The model: where its arrays are, and the few numbers that hold for all of them."""

    vocabulary: Vocabulary
    order: int
    shards: int
    #: For runs of each length, from 1: discounts of counts 1, 2 and 3 or more.
    discount: list[list[float]]
    #: Distinct pairs, and words by how many others precede them: 1, 2, 3 or more.
    pairs: int
    words_by: list[int]
    _files: Kept = field(default_factory=lambda: Kept(OPEN_RUNS), repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_files": Kept(self._files.most)}

    def _width(self, length: int) -> int:
        return 1 if length == self.order else len(STATS)

    def _shard(self, length: int, s: int) -> tuple[np.ndarray, ...]:
        name = f"run{length}-{s}"

        def mapped() -> tuple[np.ndarray, ...]:
            folder = self.vocabulary.folder
            keys, starts, code = (map_array(folder, f"{name}.{part}", kind) for part, kind in (("key", "<u4"), ("start", "<u4"), ("code", "<u1")))
            records = map_array(folder, f"{name}.record", "<u8").reshape(-1, self._width(length))
            # plain arrays over the maps, whose elements are read much faster than through the maps' own class
            return tuple(np.asarray(x).view(np.ndarray) for x in (keys, starts, code.view(f"<u{len(code) // len(keys)}") if len(keys) else code, records))

        return self._files.of(name, mapped)

    def _find(self, length: int, h: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The records of runs by hash; zeros for those never seen."""
        out = np.zeros((len(h), self._width(length)), np.int64)
        order, edges = _by_shard(shard, self.shards)
        h = h[order]
        low = (h & LOW).astype(np.uint32)
        for s in np.flatnonzero(np.diff(edges)).tolist():
            table, starts, code, records = self._shard(length, s)
            if not len(table):
                continue
            mine = low[edges[s] : edges[s + 1]]
            bucket = (h[edges[s] : edges[s + 1]] >> np.uint64(64 - (len(starts) - 1).bit_length() + 1)).astype(np.int64)
            at, end = starts[bucket].astype(np.int64), starts[bucket + 1]
            live = np.flatnonzero(at < end)
            while len(live):
                here = at[live]
                hit = table[here] == mine[live]
                out[order[edges[s] + live[hit]]] = records[code[here[hit]]]
                live = live[~hit]
                at[live] += 1
                live = live[at[live] < end[live]]
        return out

    def _kept(self, length: int, a: np.ndarray) -> np.ndarray:
        """Counts less their discounts."""
        return np.maximum(a - np.array([0.0, *self.discount[length - 1]])[np.minimum(a, 3)], 0)

    def log10(self, tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every token of encoded texts after those before it, and its training count."""
        v, deal = self.vocabulary, RunShards(self.vocabulary, self.shards)
        word, at = _padded(tokens, sizes, len(ids) - 1, self.order - 1)
        counts = v.counts(ids)
        fan = deal.fan(counts)

        # single words
        h = _run_hash([ids], len(ids))
        record = self._find(1, h, deal.of(ids, fan, _run_hash([], len(ids))))
        left = sum(d * n for d, n in zip(self.discount[0], self.words_by))
        p = (self._kept(1, record[:, 0]) + left / (v.types + 1)) / self.pairs if self.pairs else np.full(len(ids), 1.0 / (v.types + 1))
        # then longer runs, each of a known beginning and one more word; a place is where a run ends
        rank, first = word, np.arange(len(ids))
        for length in range(2, self.order + 1):
            # the first place is an end, as is what would stand before it
            distinct, longer, where = _ranked(_pairs(np.concatenate([rank[:1], rank[:-1]]), word, len(ids)))
            begin, last, ending = rank[np.maximum(where - 1, 0)], (distinct % np.uint64(len(ids))).astype(np.int64), rank[where]
            first = first[begin]
            shorter, context, before = p[ending], record[begin], h
            h = _longer(before[begin], ids[last])
            record = self._find(length, h, deal.of(ids[first], fan[first], before[ending] if length > 2 else _run_hash([ids[last]], len(last))))
            back = sum(d * context[:, 2 + k] for k, d in enumerate(self.discount[length - 1]))
            total = context[:, 1]
            p = np.where(total > 0, (self._kept(length, record[:, 0]) + back * shorter) / np.maximum(total, 1), shorter)
            rank = longer
        return np.log10(p)[rank[at]], counts[tokens]


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts from how many things were counted once, twice, three and four times."""
    if not n[0] or not n[1]:
        return [0.5 if n[0] else 0.0, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 for k in (1, 2, 3)]


def count_runs(texts: DataFrame, vocabulary: Vocabulary, order: int, shards: int) -> KneserNey:
    """Second pass over `_bytes` of the training texts: writes the arrays of runs of every length."""
    folder = vocabulary.folder
    deal = RunShards(vocabulary, shards)

    def kinds(length: int) -> tuple[str, ...]:
        return ("<u8", *["<u4"] * (length - 2), *(("<u8",) if length == order else STATS))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[np.ndarray], at: list[np.ndarray]) -> pa.RecordBatch:
            words, word, _ = _ranked(np.concatenate(parts))
            place = np.concatenate(at)
            # a run is the rank of its beginning and one more word
            tables = []
            rank = word[place - (order - 1)]
            for back in range(order - 2, 0, -1):
                table, rank, _ = _ranked(_pairs(rank, word[place - back], len(words)))
                tables.append(table)
            keys, counts = np.unique(_pairs(rank, word[place], len(words)), return_counts=True)
            columns: list[np.ndarray] = []
            width = np.uint64(len(words))
            for table in reversed([None, *tables]):
                columns.append(words[(keys % width).astype(np.int64)].astype(np.uint32))
                keys = keys // width
                if table is not None:
                    keys = table[keys.astype(np.int64)]
            columns = [words[keys.astype(np.int64)].astype(np.uint32), *reversed(columns)]
            named, blocks = _dealt(deal.of_runs(columns), shards, _rows(columns, [counts.astype("<u8")]))
            return pa.RecordBatch.from_arrays([pa.array(named, pa.int32()), pa.array(blocks, pa.binary()), pa.nulls(len(named), pa.list_(pa.int64()))], names=["shard", "block", "by"])

        parts, at, held = [], [], 0
        for batch in batches:
            for part in _slices(batch.column(0).to_pylist()):
                tokens, ids, sizes = vocabulary.encode(part)
                padded, places = _padded(ids[tokens], sizes, ids[-1], order - 1)
                parts.append(padded)
                at.append(places + held)
                held += len(padded)
                if held >= SORTED:
                    yield packed(parts, at)
                    parts, at, held = [], [], 0
        if parts:
            yield packed(parts, at)

    def merge(length: int):
        def run(table: pa.Table) -> pa.Table:
            """One shard: its arrays, then what its runs say of those one shorter."""
            s = table.column("shard")[0].as_py()
            rows = _together(table.column("block").to_pylist(), kinds(length))
            columns = _ids(rows, length)
            by_ids, starts = _grouped(columns)
            values = [_sums(x[by_ids], starts) for x in rows[-1 if length == order else -len(STATS) :]]
            columns = [c[by_ids[starts]] for c in columns]
            _write_runs(folder, f"run{length}-{s}", _run_hash(columns, len(starts)), values)
            a = values[0]
            by = np.sum([np.zeros(4 * order, np.int64), *(x for x in table.column("by").to_pylist() if x)], axis=0)
            by[4 * length - 4 : 4 * length] += [int((a == k).sum()) for k in (1, 2, 3, 4)]
            named, blocks = [s], [None]
            if length == 1:
                by = np.append(by, [int(a.sum()), int((a > 2).sum())])
            else:
                # runs that are only begun with say nothing more
                columns, a = [c[a > 0] for c in columns], a[a > 0]
                for ids, stats in (_beginnings(columns, a), _endings(columns)):
                    to, made = _dealt(deal.of_runs(ids), shards, _rows(ids, stats))
                    named, blocks = named + to, blocks + made
            often = [by.tolist(), *[None] * (len(named) - 1)]
            return pa.table({"shard": pa.array(named, pa.int32()), "block": pa.array(blocks, pa.binary()), "by": pa.array(often, pa.list_(pa.int64()))})

        return run

    schema = "shard int, block binary, by array<long>"
    found = _every_shard(texts.mapInArrow(local, schema), shards)
    for length in range(order, 0, -1):
        # each shard passes a row on to itself, so none is missing further down
        found = found.groupBy("shard").applyInArrow(merge(length), schema)
    sums = np.sum([r["by"] for r in found.select("by").collect()], axis=0).tolist()  # a row of a few numbers a shard
    by = [sums[4 * k : 4 * k + 4] for k in range(order)]
    return KneserNey(vocabulary, order, shards, [discounts(n) for n in by], sums[-2], [*by[0][:2], sums[-1]])


def train(docs: DataFrame, learn_from: Column, order: int = ORDER, shard_tokens: int = SHARD_TOKENS, shard_bytes: int = SHARD_BYTES) -> KneserNey:
    """Learns from the documents for which `learn_from` (of doc_id) holds; arrays go to the shared folder."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    texts = pick(docs, "doc_id", "text").filter(learn_from).select(text_bytes().alias("_bytes"))
    size = texts.agg(F.sum(F.octet_length("_bytes"))).first()[0] or 0
    vocabulary = count_words(texts, fresh_dir(docs.sparkSession, "lm"), ceil(log2(max(2, size / shard_bytes))))
    return count_runs(texts, vocabulary, order, max(1, ceil(vocabulary.tokens / shard_tokens)))


def score(docs: DataFrame, model: KneserNey, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_tokens, n_known long, base_score and score double of every document."""
    v = model.vocabulary

    def per_batch(texts: list[bytes]) -> dict[str, pa.Array]:
        parts = []
        for part in _slices(texts):
            tokens, ids, sizes = v.encode(part)
            starts = np.cumsum(sizes) - sizes
            found, counts = model.log10(tokens, ids, sizes)
            base = np.log10((counts + 1) / (v.tokens + v.types + 1))
            parts.append((sizes, np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(found, starts)))
        n, known, base, found = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0),) * 4
        return {"n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(found, pa.float64())}

    return map_texts(docs, list(carry), "n_tokens long, n_known long, base_score double, score double", per_batch)
