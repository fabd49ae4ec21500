"""Aligning the tokens of two tokenizers over the same bytes.

Tokens of a byte-level BPE (A) and of a piece model with byte fallback (B) cover the same text. Both split it at a single
blank between two characters that aren't white space, so a text is a row of segments, and a slice of some megabytes has
far fewer different segments than segments: each is encoded, aligned and written out once for a slice, whole texts are
sums over theirs. (Segments whose neighbours could matter are never parted; a piece that held a blank behind another
character would part nothing, and then a text is one segment.)

Groups are found by pointer jumping: a token points to the token that overlaps it and reaches farthest right; the last of
a group, an A token that ends where a B token ends, points to itself; doubling successors, for all segments of a slice at
once, brings every token to the last one of its group.

How often a pair of ids is linked in the corpus is counted by slice and pair, then by pair; what slices hold is told back
to them. A slice's rows are bounded by its bytes, and a pair that all documents hold is one row for each slice. A slice is
many small rows, its arrays in pieces: writers and readers of tables hold a hundred rows and more at a time, whatever their size.

Defined cases: null and empty texts, and texts whose tokens don't spell a blank and the text (the piece model writes a
blank for U+2581 and may normalise), have no tokens: zeros and an empty string; special tokens inside texts are plain
text; very long texts are a slice of their own; repeated rows count each; ties for the most linked A id are all best; an
empty table gives no rows; other columns are left behind unless carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.text import bounded, text_bytes
from quern.plans.columns import pick
from quern.plans.lineage import stored, written

SLICE_BYTES = 4 << 20
#: Bytes of a slice's array that are one row, and segments that are encoded at a time.
PIECE_BYTES, ENCODED = 64 << 10, 1 << 14
#: What a slice's row is: a document, a piece of one of the slice's arrays, or one of its pairs.
_DOCUMENT, _SEGMENTS, _N_LINKS, _LINKS, _PAIR = range(5)
#: Two ids in one long: B ids take the low bits.
_B_BITS = 24

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s | \s|\A | \Z")
_NAMES = ("n_a", "n_b", "n_groups", "n_links")


class _Tokenizers:
    """Both tokenizers with the bytes of their tokens, and the written forms of their ids."""

    def __init__(self, ranks: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        a_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            a_bytes[i] = token
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.parts = not any("▁" in n.lstrip("▁") for n in names)
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (a_bytes, self.b_bytes))
        # an id with what stands behind it: inside its side of a group, and at the side's end
        self.written = [b"%d%c" % (i, c) for i in range(len(a_bytes)) for c in b",|"] + [b"%d%c" % (i, c) for i in range(len(names)) for c in b",;"]
        self.b_at = 2 * len(a_bytes)

    def segments(self, text: str) -> list[str]:
        """The text without a blank before each segment; the first one's blank is the one that comes before the text."""
        if not self.parts:
            return [text]
        return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")

    def encode_a(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in a row, and how many each has; those without white space at their ends go in one text."""
        alone = np.fromiter((not s or s[0].isspace() or s[-1].isspace() for s in segments), bool, len(segments))
        counts = np.zeros(len(segments), np.int64)
        joined = [s for s, x in zip(segments, alone.tolist()) if not x]
        ids = np.array(self.a.encode_ordinary("".join([" " + s for s in joined])), np.int64)
        ends = np.cumsum([len(s.encode()) + 1 for s in joined]).astype(np.int64)
        counts[~alone] = np.diff(np.r_[-1, np.searchsorted(np.cumsum(self.a_length[ids]), ends)])
        if not alone.any():
            return ids, counts
        own = [self.a.encode_ordinary(" " + s) for s, x in zip(segments, alone.tolist()) if x]
        counts[alone] = list(map(len, own))
        whole = np.empty(int(counts.sum()), np.int64)
        of_own = np.repeat(alone, counts)
        whole[of_own], whole[~of_own] = [i for ids in own for i in ids], ids
        return whole, counts


_loaded: dict[tuple[str, str, str], _Tokenizers] = {}


def _tokenizers(*paths: str) -> _Tokenizers:
    if paths not in _loaded:
        _loaded[paths] = _Tokenizers(*paths)
    return _loaded[paths]


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For A and for B tokens, given where they end in the same bytes, the A token that ends their group."""
    n = len(a_ends)
    over_a = np.searchsorted(b_ends, a_ends)
    pointer = np.r_[n + over_a, np.searchsorted(a_ends, b_ends)]
    closed = np.flatnonzero(b_ends[over_a] == a_ends)
    pointer[closed] = closed
    while True:
        farther = pointer[pointer]
        if np.array_equal(farther, pointer):
            return pointer[:n], pointer[n:]
        pointer = farther


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over as many values in a row as `counts` says."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _aligned(segments: list[str], t: _Tokenizers) -> dict:
    """Of each segment: whether its tokens spell it, the four counts, its groups written out, and its links as pairs of ids."""
    n = len(segments)
    spelled = [b" " + s.encode() for s in segments]
    b_lists = t.b.encode(segments, num_threads=1)
    a_ids, n_a = t.encode_a(segments)
    good = np.fromiter((b"".join([t.b_bytes[i] for i in ids]) == s for ids, s in zip(b_lists, spelled)), bool, n)
    n_b = np.fromiter(map(len, b_lists), np.int64, n)
    b_ids = np.fromiter((i for ids in b_lists for i in ids), np.int64, int(n_b.sum()))
    size = np.fromiter(map(len, spelled), np.int64, n)
    good &= _sums(t.a_length[a_ids], n_a) == size
    a_ids, b_ids = a_ids[np.repeat(good, n_a)], b_ids[np.repeat(good, n_b)]
    n_a, n_b, size = n_a * good, n_b * good, size * good
    a_ends, b_ends, segment_ends = np.cumsum(t.a_length[a_ids]), np.cumsum(t.b_length[b_ids]), np.cumsum(size)
    a_last, b_last = group_ends(a_ends, b_ends)
    closing = np.flatnonzero(a_last == np.arange(len(a_ids)))
    a_group, b_group = np.searchsorted(closing, a_last), np.searchsorted(closing, b_last)
    # a group's A ids, then its B ids: a token comes after all tokens of earlier groups and of its own side
    a_is_last, b_is_last = (np.r_[g[1:] != g[:-1], np.ones(min(1, len(g)), bool)] for g in (a_group, b_group))
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    codes[np.arange(len(a_ids)) + np.searchsorted(b_group, a_group)] = 2 * a_ids + a_is_last
    codes[np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, "right")] = t.b_at + 2 * b_ids + b_is_last
    forms = [t.written[c] for c in codes.tolist()]
    ends = np.cumsum(n_a + n_b).tolist()
    said = [b"".join(forms[a:b]) for a, b in zip([0, *ends], ends)]
    places = np.union1d(a_ends, b_ends)
    pairs = (a_ids[np.searchsorted(a_ends, places)] << _B_BITS) | b_ids[np.searchsorted(b_ends, places)]
    n_links = np.diff(np.r_[0, np.searchsorted(places, segment_ends, "right")])
    n_groups = np.diff(np.r_[0, np.searchsorted(a_ends[closing], segment_ends, "right")])
    return {"good": good, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "said": said, "pairs": pairs}


def _aligned_in_parts(segments: list[str], t: _Tokenizers) -> dict:
    """`_aligned` of all segments, some at a time, so that few are objects of their own at once."""
    made = [_aligned(segments[i : i + ENCODED], t) for i in range(0, len(segments), ENCODED)] or [_aligned([], t)]
    return {k: [x for part in made for x in part[k]] if k == "said" else np.concatenate([part[k] for part in made]) for k in made[0]}


def _pieces(values: np.ndarray) -> list[bytes]:
    data = values.astype(np.int32).tobytes()
    return [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


def _slices(source: DataFrame, carry: int, tokenizers: tuple[str, str, str], digest_only: bool) -> tuple[DataFrame, list[str]]:
    """Rows of slices, by `kind`: documents with n, how many segments they have; pieces of the segments of all documents, of
    how many links a segment has and of the links, which are places of pairs; and pairs with n, how often they are linked in
    the slice. `at` is the place among a slice's rows of one kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(*tokenizers)
        number = TaskContext.get().partitionId() << 32
        for batch in bounded(batches, "_bytes", SLICE_BYTES):
            if not batch.num_rows:
                continue
            local: defaultdict = defaultdict(int)
            local.default_factory = local.__len__
            found = []
            for text in batch.column("_bytes"):
                text = text.as_py()
                segments = t.segments(text.decode("utf-8", "replace")) if text else []
                found.append(np.fromiter(map(local.__getitem__, segments), np.int32, len(segments)))
            made = _aligned_in_parts(list(local), t)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            segments = np.concatenate(found)
            good = (_sums(made["good"][segments], sizes) == sizes) & (sizes > 0)
            sums = {k: _sums(made[k][segments], sizes) * good for k in _NAMES}
            said = made["said"]
            last = (lambda x: hashlib.sha256(x).hexdigest()) if digest_only else bytes.decode
            texts = [last(b"".join([said[i] for i in s.tolist()])[:-1]) if g else "" for s, g in zip(found, good)]
            kept = np.repeat(good, sizes)
            segments, sizes = segments[kept], sizes * good
            # how often the good documents hold each segment, so how often its links are there
            held = np.bincount(segments, minlength=len(local))
            pairs, links = np.unique(made["pairs"], return_inverse=True)
            counts = np.bincount(links, np.repeat(held, made["n_links"]), len(pairs)).astype(np.int64)
            carried = dict(zip(names, [*batch.columns[:carry], *[pa.array(sums[k]) for k in _NAMES], pa.array(texts, pa.string())]))
            empty = {k: x.type for k, x in carried.items()}
            arrays = [(kind, i, x) for kind, values in ((_SEGMENTS, segments), (_N_LINKS, made["n_links"]), (_LINKS, links)) for i, x in enumerate(_pieces(values))]
            held = np.flatnonzero(counts)
            for kind, at, own in (
                (np.full(len(sizes), _DOCUMENT), np.arange(len(sizes)), carried | {"n": pa.array(sizes)}),
                (np.array([x[0] for x in arrays], int), np.array([x[1] for x in arrays], int), {"data": pa.array([x[2] for x in arrays], pa.binary())}),
                (np.full(len(held), _PAIR), held, {"n": pa.array(counts[held]), "pair": pa.array(pairs[held])}),
            ):
                own |= {"slice": pa.array(np.full(len(at), number)), "kind": pa.array(kind, pa.int32()), "at": pa.array(at, pa.int32())}
                yield pa.RecordBatch.from_arrays([own[k] if k in own else pa.nulls(len(at), empty.get(k) or types[k]) for k in columns], names=columns)
            number += 1

    kinds = dict(source.dtypes)
    names = [*[f"_c{i}" for i in range(carry)], *_NAMES, "groups"]
    types = {"slice": pa.int64(), "kind": pa.int32(), "at": pa.int32(), "n": pa.int64(), "pair": pa.int64(), "data": pa.binary()}
    columns = [*types, *names]
    fields = ", ".join([*(f"_c{i} {kinds[f'_c{i}']}" for i in range(carry)), *(f"{k} long" for k in _NAMES), "groups string"])
    return source.mapInArrow(run, f"slice long, kind int, at int, n long, pair long, data binary, {fields}"), names


def _pair_counts(slices: DataFrame) -> DataFrame:
    """pair, count, and best: whether no other pair with the same B id is linked more often."""
    counted = slices.filter(F.col("kind") == _PAIR).groupBy("pair").agg(F.sum("n").alias("count"))
    counted = written(counted).withColumn("_b", F.col("pair").bitwiseAND((1 << _B_BITS) - 1))
    most = counted.groupBy("_b").agg(F.max("count").alias("_most"))
    return counted.join(most, "_b").select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def pair_counts(docs: DataFrame, tokenizers: tuple[str, str, str]) -> DataFrame:
    """a_id, b_id, count (links of the two ids in all documents) and best (none of the B id is more frequent)."""
    slices = written(_slices(pick(docs, "text").select(text_bytes().alias("_bytes")), 0, tokenizers, True)[0].filter(F.col("kind") == _PAIR).select("kind", "pair", "n"))
    rows = _pair_counts(slices)
    return rows.select(F.shiftright("pair", _B_BITS).alias("a_id"), F.col("pair").bitwiseAND((1 << _B_BITS) - 1).alias("b_id"), "count", "best")


def align(docs: DataFrame, tokenizers: tuple[str, str, str], carry: tuple[str, ...] = ("doc_id",), digest_only: bool = False) -> DataFrame:
    """The carried columns, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, a row for each document.

    `tokenizers` are paths of A's ranks, A's pattern and B's model. n_best counts links that no other A id has more often
    with the same B id, in all documents; count_sum adds up the counts of links. groups is `a1,a2|b1;a3|b2,b3`, or with
    `digest_only` in its place groups_sha256.
    """
    source = pick(docs, *dict.fromkeys([*carry, "text"])).select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], text_bytes().alias("_bytes"))
    slices, names = _slices(source, len(carry), tokenizers, digest_only)
    slices, _ = stored(slices)
    counts = _pair_counts(slices)
    held = slices.filter(F.col("kind") == _PAIR).select("slice", F.col("at").alias("place"), "pair")
    told = held.join(counts, "pair").select(F.col("slice").alias("of"), "place", "count", "best")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        def part(kind: int) -> pa.Table:
            rows = left.filter(pc.equal(left.column("kind"), kind))
            return rows.take(pa.array(np.argsort(rows.column("at").to_numpy())))

        documents = part(_DOCUMENT)
        sizes = documents.column("n").to_numpy()
        segments, n_links, links = (np.frombuffer(b"".join(part(k).column("data").to_pylist()), np.int32) for k in (_SEGMENTS, _N_LINKS, _LINKS))
        place = right.column("place").to_numpy()
        size = max(links.max(initial=-1), place.max(initial=-1)) + 1
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        made = [pa.array(_sums(_sums(x[links], n_links)[segments], sizes)) for x in (best, count)]
        return pa.Table.from_arrays([*[documents.column(c) for c in names], *made], names=[*names, "n_best", "count_sum"]).cast(schema)

    kinds = dict(source.dtypes)
    out = ", ".join([*(f"_c{i} {kinds[f'_c{i}']}" for i in range(len(carry))), *(f"{k} long" for k in _NAMES), "groups string, n_best long, count_sum long"])
    from pyspark.sql.pandas.types import to_arrow_type

    types = {f"_c{i}": to_arrow_type(source.schema[f"_c{i}"].dataType) for i in range(len(carry))} | {"groups": pa.string()}
    schema = pa.schema([(n, types.get(n, pa.int64())) for n in [*names, "n_best", "count_sum"]])
    whole = slices.filter(F.col("kind") != _PAIR).drop("pair").groupBy("slice").cogroup(told.groupBy("of")).applyInArrow(add_up, out)
    last = F.col("groups").alias("groups_sha256" if digest_only else "groups")
    return whole.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *_NAMES, "n_best", "count_sum", last)
