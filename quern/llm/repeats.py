"""Repeated passages of whole texts, found by suffix order in parts of the corpus that can hold them.

A passage is a string of `length` bytes that starts at two or more places. Whole texts aren't sorted; only suffixes that
can share so many bytes meet:

1. Every window of `length` bytes is known by its least seed (a substring of `seed` bytes, by hash), which equal windows
   have in common, at the same place in them. Neighbouring windows with the same seed are a context; contexts are written
   with the seed's hash, the hash of all of their bytes, and their place.
2. Contexts that are alone with their seed hold no passage. Those of a seed that are all alike are settled by their
   number. For the others the bytes left and right of the seed are fetched once for each different context.
3. In a bucket of contexts with the same seeds, the seed is one letter, a window is `length - seed + 1` letters, and
   suffixes are sorted to that depth by doubling. With the previous and the next smaller position in suffix order
   the longest previous factor of a window reaches `length` or doesn't: that says which windows have an earlier copy.
4. A seed with more different contexts than a bucket takes is settled by counting its windows' letters themselves.

Hashes take 64 bits; a seed's windows are compared by their letters. What moves is contexts (one for about every 130
bytes), and each text twice: to fetch what differs, and to take passages out.

Defined cases: a null text is empty, texts shorter than `length` hold no passage, very long texts are cut into parts of
bounded size that overlap, so that memory is bounded by the text itself; repeated rows are copies like any other; an empty
table gives no rows; other columns are left behind unless carried. Which copy comes first is told by `doc_id` (nulls
first), then by the row's place in the table and the place in the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.text import bounded, text_bytes
from quern.plans.columns import pick
from quern.plans.lineage import written
from quern.plans.rows import numbered

LENGTH = 400
#: Windows of text hashed at a time, and letters of contexts sorted at a time.
CHUNK, SORTED_LETTERS = 1 << 19, 1 << 20
#: Different contexts that a seed may have in a bucket.
MOST_CONTEXTS = 1 << 12
#: Contexts that a task settles, about: sorting takes long for a byte read, so tasks follow their number and not their size.
TASK_CONTEXTS = 1 << 14

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LETTERS = np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def seed_bytes(length: int) -> int:
    """Bytes of a seed: a window has a power of two of places for it, about two thirds of its length."""
    return length + 1 - (1 << ((2 * length // 3).bit_length() - 1))


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        ups, downs = (np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        ups[0] = downs[0] = 1
        _powers[size] = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
    return _powers[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of any substring of a chunk, from running sums."""

    def __init__(self, data: np.ndarray):
        self.ups, downs = _scales(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * downs[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        # scaled so that the last letter has the same weight wherever the substring lies
        return _mixed((self.sums[ends] - self.sums[starts]) * self.ups[starts] + (ends - starts).astype(np.uint64))


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of its least one by the high bits, the first of equal ones."""
    n = len(values) - width + 1
    low = np.uint64((1 << len(values).bit_length()) - 1)
    padded = np.full(-(-len(values) // width) * width, _MASK, np.uint64)
    padded[: len(values)] = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], before[width - 1 : width - 1 + n]) & low).astype(np.int64)


def _contexts(text: bytes, length: int, seed: int) -> dict[str, np.ndarray]:
    """A chunk's contexts: seed's hash, context's hash, first window, windows, place of the seed from the first window."""
    data = np.frombuffer(text, np.uint8)
    hashes = _Hashes(data)
    at = np.arange(len(data) - seed + 1)
    seeds = hashes.of(at, at + seed)
    place = _least_places(seeds, length - seed + 1)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    windows = np.diff(np.r_[first, len(place)])
    offset = place[first] - first
    whole = hashes.of(first, first + windows - 1 + length)
    whole = _mixed(whole + (offset.astype(np.uint64) << np.uint64(32)))
    return {"seed": seeds[place[first]].view(np.int64), "context": whole.view(np.int64), "start": first, "windows": windows, "offset": offset}


def _chunks(size: int, length: int) -> Iterator[tuple[int, int]]:
    """Ranges of bytes whose windows are all the windows of a text."""
    at = 0
    while at + length <= size:
        yield at, min(size, at + CHUNK + length - 1)
        at += CHUNK


def _find_contexts(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """_row, order, seed, context, start, windows, offset and copies: equal contexts that start one byte apart are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_bytes", 4 * CHUNK):
            parts = []
            for i, text in enumerate(batch.column("_bytes")):
                text = text.as_py()
                for begin, end in _chunks(len(text), length):
                    made = _contexts(text[begin:end], length, seed)
                    made["start"] = made["start"] + begin
                    same = (made["context"][1:] == made["context"][:-1]) & (made["windows"][1:] == 1) & (made["windows"][:-1] == 1)
                    first = np.flatnonzero(np.r_[True, ~same])
                    copies = np.diff(np.r_[first, len(made["start"])])
                    made = {k: v[first] for k, v in made.items()} | {"copies": copies, "_i": np.full(len(first), i)}
                    parts.append(made)
            if parts:
                whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                at = pa.array(whole.pop("_i"))
                kept = [batch.column("_row").take(at), batch.column("_order").take(at)]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(whole[k]) for k in names]], names=["_row", "_order", *names])

    names = ["seed", "context", "start", "windows", "offset", "copies"]
    kind = dict(rows.dtypes)["_order"]
    return rows.select("_row", "_order", "_bytes").mapInArrow(run, f"_row long, _order {kind}, " + ", ".join(f"{n} long" for n in names))


def suffix_ranks(letters: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first `depth` letters (a power of two), equal ones alike, by doubling."""
    ranks = np.unique(letters, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < depth:
        behind = np.zeros_like(ranks)
        behind[: max(0, len(ranks) - reach)] = ranks[reach:] + 1
        ranks = np.unique(ranks * (len(ranks) + 1) + behind, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return ranks


def smaller_positions(positions: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller position, -1 where there is none; by jumps over found ones."""
    found = np.arange(len(positions)) - 1
    while True:
        wrong = np.flatnonzero((found >= 0) & (positions[found] > positions))
        if not len(wrong):
            return found
        found[wrong] = found[found[wrong]]


def factor_flags(ranks: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows with ranks of their letters and positions in the text: has an earlier copy, has any other copy.

    In suffix order the earlier suffix with the longest common start is the previous or the next smaller position, so the
    longest previous factor is as long as a window just where one of these two has the window's rank.
    """
    order = np.lexsort((positions, ranks))
    ranks, positions = ranks[order], positions[order]
    n = len(order)
    previous = smaller_positions(positions)
    following = n - 1 - smaller_positions(positions[::-1])[::-1]
    like = lambda at: (at >= 0) & (at < n) & (ranks[np.clip(at, 0, n - 1)] == ranks)
    earlier = np.empty(n, bool)
    earlier[order] = like(previous) | like(following)
    other = np.empty(n, bool)
    at = np.arange(n)
    other[order] = like(at - 1) | like(at + 1)
    return earlier, other


def _settle(contexts: list[dict], depth: int) -> Iterator[dict]:
    """Flags of the windows of contexts, of which all with one group are there."""
    letters, window_at, window_of = [], [], []
    size, group, last = 0, 255, None
    for i, c in enumerate(contexts):
        if c["g"] != last:
            group, last = group + 1, c["g"]
        # one letter stands for the seed: all windows of the context hold it, and other groups have another one
        line = np.concatenate([np.frombuffer(c["left"], np.uint8), [group], np.frombuffer(c["right"], np.uint8), [-1]]).astype(np.int64)
        window_at.append(size + np.arange(c["windows"]))
        window_of.append(np.full(c["windows"], i))
        letters.append(line)
        size += len(line)
    ranks = suffix_ranks(np.concatenate(letters), depth)
    starts = np.cumsum([0, *[c["windows"] for c in contexts]])
    window_at, window_of = np.concatenate(window_at), np.concatenate(window_of)
    place = lambda c: (c["_order"] is not None, c["_order"], c["_row"], c["start"])
    first = np.empty(len(contexts), np.int64)
    first[sorted(range(len(contexts)), key=lambda i: place(contexts[i]))] = np.arange(len(contexts))
    positions = first[window_of] * depth + np.arange(len(window_of)) - starts[window_of]
    earlier, other = factor_flags(ranks[window_at], positions)
    for i, c in enumerate(contexts):
        own = slice(starts[i], starts[i + 1])
        yield {"g": c["g"], "c": c["c"], "earlier": np.packbits(earlier[own]).tobytes(), "other": np.packbits(other[own]).tobytes()}


_FLAGS = "g long, c long, earlier binary, other binary"
_FLAG_TYPE = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("earlier", pa.binary()), ("other", pa.binary())])


def _settled(items: DataFrame, depth: int, tasks: int) -> DataFrame:
    """Flags of small groups: suffixes of many groups are sorted at a time, and of a group all at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for c in batch.to_pylist():
                if size >= SORTED_LETTERS and held[-1]["g"] != c["g"]:
                    yield pa.RecordBatch.from_pylist(list(_settle(held, depth)), schema=_FLAG_TYPE)
                    held, size = [], 0
                held.append(c)
                size += len(c["left"]) + len(c["right"]) + 2
        if held:
            yield pa.RecordBatch.from_pylist(list(_settle(held, depth)), schema=_FLAG_TYPE)

    return items.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(run, _FLAGS)


def _halves(items: DataFrame, depth: int, span: int) -> DataFrame:
    """Each context's windows whose seed lies in the lower and in the upper half of its `span` places from `low`, as contexts
    of groups that also share the bytes which all windows of the half hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                for half in (0, 1):
                    least = c["low"] + half * span // 2
                    most = least + span // 2
                    begin, end = max(0, c["offset"] - most + 1), min(c["windows"], c["offset"] - least + 1)
                    if begin < end:
                        offset = c["offset"] - begin
                        left, right = c["left"][begin:], c["right"][: end - 1 + depth - 1 - c["offset"]]
                        core = b"%d %d %b|%b" % (c["g"], least, left[len(left) - least :], right[: depth - most])
                        g = hashlib.blake2b(core, digest_size=8).digest()
                        own = hashlib.blake2b(b"%d %d %b|%b" % (offset, end - begin, left, right), key=g, digest_size=8).digest()
                        g, own = (int.from_bytes(x, "little", signed=True) for x in (g, own))
                        made = {"parent_g": c["g"], "parent_c": c["c"], "half": half, "g": g, "c": own, "start": c["start"] + begin, "windows": end - begin, "offset": offset, "low": least, "left": left, "right": right}
                        out.append(c | made)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*parents, *batch.schema]))

    parents = [("parent_g", pa.int64()), ("parent_c", pa.int64()), ("half", pa.int64())]
    parents = [pa.field(*f) for f in parents]
    kinds = dict(items.dtypes)
    return items.select(*_ITEM).mapInArrow(run, "parent_g long, parent_c long, half long, " + ", ".join(f"`{n}` {kinds[n]}" for n in _ITEM))


#: A context (c) of a group of them (g): where it first is, its windows, places left of the seed, and letters at both sides.
_ITEM = ["g", "c", "_order", "_row", "start", "windows", "offset", "low", "left", "right"]


def _own_bits(n: int, is_first: bool, windows: int, bits: bytes | None, kind: str) -> np.ndarray:
    """Flags of one occurrence of a context that is there `n` times, from those of its first one among other contexts."""
    if n > 1 and (kind == "other" or not is_first):
        return np.ones(windows, bool)
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=windows).astype(bool) if bits else np.zeros(windows, bool)


def _both_halves(rows: DataFrame) -> DataFrame:
    """Flags of contexts from those of their halves; the upper half's windows come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda x: -x["half"])
                made = {k: np.packbits(np.concatenate([_own_bits(x["n"], x["is_first"], x["windows"], x[k], k) for x in parts])).tobytes() for k in ("earlier", "other")}
                out.append({"g": r["parent_g"], "c": r["parent_c"], **made})
            yield pa.RecordBatch.from_pylist(out, schema=_FLAG_TYPE)

    parts = F.collect_list(F.struct("half", "n", "is_first", "windows", "earlier", "other")).alias("parts")
    return rows.groupBy("parent_g", "parent_c").agg(parts).mapInArrow(run, _FLAGS)


def _at(prefix: str = "") -> list[str]:
    return [f"{prefix}{k}" for k in ("_order", "_row", "start")]


def _flags(items: DataFrame, depth: int, span: int) -> DataFrame:
    """g, c, earlier and other (bits) of different contexts, each of which is compared with those of its group.

    Groups of more contexts than a task takes are halved by the seed's place in the window, again and again: a half shares
    more bytes, so it parts into more groups, and at a single place all of a group's contexts are one.
    """
    sized = items.join(items.groupBy("g").agg(F.count(F.lit(1)).alias("_m")), "g")
    small = _settled(sized.filter(F.col("_m") <= MOST_CONTEXTS).select(*_ITEM), depth, max(1, ceil(items.count() / TASK_CONTEXTS)))
    large = sized.filter(F.col("_m") > MOST_CONTEXTS)
    if span < 2 or large.isEmpty():
        return small
    halves = written(_halves(large, depth, span))
    first = F.min(F.struct(*_at(), *[c for c in _ITEM[2:] if c not in _at()])).alias("_f")
    distinct = written(halves.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), first).select("g", "c", "n", "_f.*"))
    found = _flags(distinct.select(*_ITEM), depth, span // 2)
    # written, so that the join below is one that Spark can split at a hot context
    known = written(distinct.select("g", "c", "n", *[F.col(k).alias(f"f{k}") for k in _at()]).join(found, ["g", "c"], "left"))
    is_first = (F.col("_row") == F.col("f_row")) & (F.col("start") == F.col("fstart"))
    rows = halves.select("parent_g", "parent_c", "half", "g", "c", "windows", *_at()).join(known, ["g", "c"])
    return small.union(_both_halves(rows.withColumn("is_first", is_first)))


def _letters(rows: DataFrame, wanted: DataFrame, length: int, seed: int) -> DataFrame:
    """The items of contexts, with the letters at both sides of their seeds taken from the texts they are first in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column("_bytes"), batch.column("asked")):
                text, out = text.as_py(), []
                for c in asked.as_py():
                    at = c["start"] + c["offset"]
                    c["left"], c["right"] = text[c["start"] : at], text[at + seed : c["start"] + c["windows"] - 1 + length]
                    out.append(c)
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*asked.type.value_type, pa.field("left", pa.binary()), pa.field("right", pa.binary())]))

    fields = _ITEM[:-2]
    kinds = dict(wanted.dtypes)
    asked = wanted.select(F.col("_row").alias("_at"), F.struct(*fields).alias("_c")).groupBy("_at").agg(F.collect_list("_c").alias("asked"))
    texts = rows.select(F.col("_row").alias("_at"), "_bytes").join(asked, "_at").select("_bytes", "asked")
    return texts.mapInArrow(run, ", ".join([*(f"`{f}` {kinds[f]}" for f in fields), "left binary, right binary"]))


def repeated_windows(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """_row, start, windows, n, is_first, copies, earlier and other: contexts of `rows` (_row, _order, _bytes) that hold a window
    with a copy. `n` occurrences of the context are there; the bits are about its first one."""
    seed = seed_bytes(length)
    depth = length - seed + 1
    found = written(_find_contexts(rows, length, seed))
    contexts = found.groupBy("seed", "context").agg(F.sum("copies").alias("n"), F.min(F.struct("_order", "_row", "start", "windows", "offset")).alias("_f"))
    seeds = contexts.groupBy("seed").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_m")).filter("_n > 1").select("seed", "_m")
    contexts = written(contexts.join(seeds, "seed").select("seed", "context", "n", "_m", "_f.*"))
    wanted = contexts.filter("_m > 1").select(F.col("seed").alias("g"), F.col("context").alias("c"), "_order", "_row", "start", "windows", "offset", F.lit(0).cast("long").alias("low"))
    items = written(_letters(rows, wanted, length, seed))
    flags = _flags(items, depth, depth).withColumnsRenamed({"g": "seed", "c": "context"})
    known = contexts.select("seed", "context", "n", *[F.col(k).alias(f"f{k}") for k in _at()]).join(flags, ["seed", "context"], "left")
    known = written(known.filter("n > 1 OR earlier IS NOT NULL"))
    is_first = (F.col("_row") == F.col("f_row")) & (F.col("start") == F.col("fstart"))
    met = found.select("seed", "context", "_row", "start", "windows", "copies").join(known, ["seed", "context"])
    return met.select("_row", "start", "windows", "copies", "n", is_first.alias("is_first"), "earlier", "other")


def covered(contexts: list[dict], kind: str, length: int) -> list[tuple[int, int]]:
    """Maximal ranges of bytes that flagged windows cover, in order."""
    starts = []
    for c in contexts:
        bits = _own_bits(c["n"], c["is_first"], c["windows"], c[kind], kind)
        if c["copies"] > 1:  # one window each, one byte apart
            bits = np.r_[bits, np.ones(c["copies"] - 1, bool)]
        starts.append(c["start"] + np.flatnonzero(bits))
    at = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length) + 1
    return list(zip(at[np.r_[0, cut]].tolist(), (at[np.r_[cut - 1, len(at) - 1]] + length).tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", carry: tuple[str, ...] = ("doc_id",), digest_only: bool = False) -> DataFrame:
    """The carried columns, n_bytes, n_removed, spans (start, end of removed bytes) and kept, the bytes that are left.

    A byte goes if a string of `length` bytes over it starts elsewhere too: with keep="first" somewhere earlier, so the first
    copy stays; with keep="none" anywhere. What is repeated is judged on the whole input, not on what is left of it. With
    `digest_only`, kept_sha256 (lower-case hex) takes the place of kept.
    """
    if keep not in ("first", "none"):
        raise ValueError('keep is "first" or "none"')
    kind = "earlier" if keep == "first" else "other"
    rows = numbered(docs, *dict.fromkeys([*carry, "doc_id", "text"]))
    rows = rows.select("_row", F.col("doc_id").alias("_order"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], text_bytes().alias("_bytes"))
    met = repeated_windows(rows, length).groupBy("_row").agg(F.collect_list(F.struct("start", "windows", "copies", "n", "is_first", kind)).alias("_met"))
    last = "kept_sha256" if digest_only else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_bytes"):
            texts, found = batch.column("_bytes"), batch.column("_met")
            out = {"n_bytes": [], "n_removed": [], "spans": [], last: []}
            for text, contexts in zip(texts, found):
                text = text.as_py()
                spans = covered(contexts.as_py() or [], kind, length)
                edges = [0, *[x for span in spans for x in span], len(text)]
                left = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(left))
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                out[last].append(hashlib.sha256(left).hexdigest() if digest_only else left)
            kept = [batch.column(f"_c{i}") for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, types[k]) for k, v in out.items()]], names=[*carry, *out])

    types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary(), "kept_sha256": pa.string()}
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[f'_c{i}']}" for i, c in enumerate(carry)), "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>", f"{last} {'string' if digest_only else 'binary'}"])
    return rows.join(met, "_row", "left").select(*[f"_c{i}" for i in range(len(carry))], "_bytes", "_met").mapInArrow(run, schema)
