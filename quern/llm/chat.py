"""Chat formatting as a prefix tree of tokens.

Conversations that share initial turns share tree nodes. Every node's tokens are emitted once, in depth-first order, with
their place in that order, the position id of the first from the root, and the places of its ancestors: the intervals it
may attend to besides itself. A node is known by a digest of all turns from the root; it is owned by the smallest
conversation that passes it, so sizes of subtrees are sums over conversations' own turns, and no task sees a tree.

A turn becomes `<|turn|>role<|text|>...<|end|>`, whose head, text and end are encoded apart by a byte-level tokenizer: ids
are decoded to exactly what was formatted, and the loss mask covers whole tokens. Control strings inside roles and texts,
of this template or of other common ones, get a backslash after their first character, one more where there are some
already; reading takes it out. Texts are encoded where they are scanned, so only ids are shuffled, and what places nodes
is their ids and lengths alone.

Defined cases: null texts and roles count as empty; turns are taken in the order of turn (null first), then role and
text, and repeated rows are turns of their own; rows with a null conv_id are conversations of one turn each, and equal
ones are formatted once and told as often as they are there; a conversation of any length, and a text of any length, is
one conversation, in one task; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.text import bounded
from quern.plans.columns import pick
from quern.plans.lineage import cut, written
from quern.plans.prefix import bucket_bits, running_total

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_RESTS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_RESTS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_RESTS})")
TRAINED = "assistant"
#: Pieces of text that a worker keeps the ids of, conversations and bytes of ids that are objects at a time.
CACHE_PIECES, CONVERSATIONS, PART = 400_000, 256, 4 << 20


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """A turn's segment in three parts: all before the text, the text, its end."""
    return f"{TURN}{escape(role)}{TEXT}", escape(text), END


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, text = part.removesuffix(END).split(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


class Tokens(dict):
    """Byte-level ids from a file of ranks, a line each of a token in base 64 and its id; `pattern` parts texts before."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.path, self.pattern = path, pattern

    def __reduce__(self):
        return tokens_of, (self.path, self.pattern)

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    @cached_property
    def kind(self) -> str:
        return "<u2" if max(self.ranks.values()) < 1 << 16 else "<u4"

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize

    @cached_property
    def bytes_of(self) -> list[bytes]:
        table = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            table[i] = b
        return table

    @cached_property
    def _encoding(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def _pieces(self):
        import regex

        return regex.compile(self.pattern).findall

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = np.array(self._encoding.encode_ordinary(piece), self.kind).tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as whole numbers of `kind` in a row."""
        return b"".join(map(self.__getitem__, self._pieces(text)))

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind)

    def decode(self, raw: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, self.ids(raw).tolist())).decode()


@cache
def tokens_of(path: str, pattern: str) -> Tokens:
    return Tokens(path, pattern)


@dataclass(frozen=True)
class PrefixTrees:
    #: key, conv_id and copies of the owner, depth, node, parent (null: root), start, position, length, ids (whole
    #: numbers of the tokens' kind), body_start, body_length, trained, ancestors.
    nodes: DataFrame
    #: key, conv_id, copies, depth, node, own: the way from the root of each conversation.
    paths: DataFrame
    tokens: Tokens

    def training_rows(self) -> DataFrame:
        """node, start, token_ids, position_ids, loss_mask (arrays, an element a token) and ancestors of every node."""
        tokens = self.tokens

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, "ids", PART):
                ids = [tokens.ids(x).astype(np.int32) for x in batch.column("ids").to_pylist()]
                first, at, size, trained = (batch.column(c).to_pylist() for c in ("position", "body_start", "body_length", "trained"))
                position = [np.arange(p, p + len(i)) for p, i in zip(first, ids)]
                mask = [t & (np.arange(len(i)) >= a) & (np.arange(len(i)) < a + n) for i, a, n, t in zip(ids, at, size, trained)]
                made = [pa.array(ids, pa.list_(pa.int32())), pa.array(position, pa.list_(pa.int64())), pa.array(mask, pa.list_(pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("start"), *made, batch.column("ancestors")], names=["node", "start", "token_ids", "position_ids", "loss_mask", "ancestors"])

        out = "node binary, start long, token_ids array<int>, position_ids array<long>, loss_mask array<boolean>, ancestors array<struct<start: long, end: long>>"
        return self.nodes.select("node", "start", "position", "ids", "body_start", "body_length", "trained", "ancestors").mapInArrow(run, out)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations, some at a time: only those are objects."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), CONVERSATIONS):
            yield batch.slice(at, CONVERSATIONS)


def _encode(tokens: Tokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            ids, at, size, trained = [], [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                head, body, end = map(tokens.encode, format_turn(role, text))
                ids.append(head + body + end)
                at.append(len(head) // tokens.width)
                size.append(len(body) // tokens.width)
                trained.append(role == TRAINED)
            made = [pa.array(ids, pa.binary()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(trained, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *made], names=["conv_id", "turn", "ids", "body_start", "body_length", "trained"])

    return run


def _chained(tokens: Tokens):
    """Each conversation's turns in order, and the digest of each with all before it."""

    def place(t: dict) -> tuple:
        ((role, text),) = read_turns(tokens.decode(t["ids"]))
        return t["turn"], role, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            nodes, ordered = [], []
            for turns in batch.column("turns").to_pylist():
                # texts are read only where turns tie
                distinct = len({t["turn"] for t in turns}) == len(turns)
                turns.sort(key=(lambda t: t["turn"]) if distinct else place)
                digest, way = b"", []
                for t in turns:
                    digest = hashlib.blake2b(digest + t["ids"], digest_size=16).digest()
                    way.append(digest)
                nodes.append(way)
                ordered.append(turns)
            columns = [batch.column(c) for c in ("key", "conv_id", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ordered, batch.schema.field("turns").type), pa.array(nodes, pa.list_(pa.binary()))], names=["key", "conv_id", "copies", "turns", "nodes"])

    return run


_NODES = {
    "depth": pa.int32(), "node": pa.binary(), "parent": pa.binary(), "start": pa.int64(), "position": pa.int64(), "length": pa.int64(), "ids": pa.binary(),
    "body_start": pa.int32(), "body_length": pa.int32(), "trained": pa.bool_(), "ancestors": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
}


def _emit(width: int):
    """The nodes that each conversation owns, with the intervals of their ancestors; intervals that touch are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out: dict[str, list] = {n: [] for n in _NODES}
            rows: list[int] = []
            for i, (way, turns, nodes) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("way", "turns", "nodes")))):
                spans: list[dict[str, int]] = []
                for depth, (t, said, node) in enumerate(zip(way, turns, nodes)):
                    length = len(said["ids"]) // width
                    if t["own"]:
                        rows.append(i)
                        parent = nodes[depth - 1] if depth else None
                        values = (depth, node, parent, t["start"], t["position"], length, said["ids"], said["body_start"], said["body_length"], said["trained"], [dict(s) for s in spans])
                        for column, value in zip(out.values(), values):
                            column.append(value)
                    if spans and spans[-1]["end"] == t["start"]:
                        spans[-1] = {"start": spans[-1]["start"], "end": t["start"] + length}
                    else:
                        spans.append({"start": t["start"], "end": t["start"] + length})
            arrays = [pa.array(v, _NODES[n]) for n, v in out.items()]
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("key", "conv_id", "copies")]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names=["key", "conv_id", "copies", *out])

    return run


def prefix_trees(conversations: DataFrame, tokens: Tokens) -> PrefixTrees:
    """The trees of all conversations, laid end to end, and each conversation's way through them."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    kind = dict(rows.dtypes)["conv_id"]
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    rows = rows.select("conv_id", turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    encoded = lambda some: some.mapInArrow(_encode(tokens), f"conv_id {kind}, turn long, ids binary, body_start int, body_length int, trained boolean")
    said = F.struct("turn", "ids", "body_start", "body_length", "trained")
    whole = encoded(rows.filter("conv_id IS NOT NULL")).groupBy("conv_id").agg(F.collect_list(said).alias("turns"))
    whole = whole.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("key"), "conv_id", F.lit(1).cast("long").alias("copies"), "turns")
    if not rows.filter("conv_id IS NULL").isEmpty():
        # rows of no conversation: equal ones are counted before anything is shuffled
        alone = encoded(rows.filter("conv_id IS NULL")).groupBy("ids", "body_start", "body_length", "trained").agg(F.count(F.lit(1)).alias("copies")).withColumn("turn", F.lit(0).cast("long"))
        whole = whole.union(alone.select(F.concat(F.lit("n"), F.sha2("ids", 256)).alias("key"), F.lit(None).cast(kind).alias("conv_id"), "copies", F.array(said).alias("turns")))
    turns = "array<struct<turn: long, ids: binary, body_start: int, body_length: int, trained: boolean>>"
    known = written(whole.mapInArrow(_chained(tokens), f"key string, conv_id {kind}, copies long, turns {turns}, nodes array<binary>"))

    # places come from digests and lengths alone; the ids join what has been placed
    step = F.arrays_zip(F.col("nodes").alias("node"), F.transform("turns", lambda t: F.octet_length(t["ids"]) / tokens.width).alias("length"))
    light = known.select("key", "conv_id", "copies", "nodes", F.posexplode(step).alias("depth", "_t"))
    light = light.select("key", "conv_id", "copies", "depth", F.col("_t.node").alias("node"), F.get("nodes", F.col("depth") - 1).alias("parent"), F.col("_t.length").cast("long").alias("length"))
    # a table of its own, so that Spark can split the join at a node that very many conversations pass
    owners = cut(light.groupBy(F.col("node").alias("_n")).agg(F.min("key").alias("_owner")))
    owned = light.join(owners, F.col("node") == F.col("_n")).withColumn("own", F.col("key") == F.col("_owner")).drop("_n", "_owner")
    below = F.sum(F.when(F.col("own"), F.col("length")).otherwise(0)).over(W.partitionBy("key").orderBy(F.col("depth").desc()))
    owned = written(owned.withColumn("_below", below))

    sizes = owned.groupBy("node", "parent").agg(F.sum("_below").alias("_size")).withColumn("_h", F.xxhash64("node"))
    before = running_total(sizes, ["parent"], "_h", ["node"], F.col("_size"), "_before", bucket_bits(owned.count()))
    before = cut(before.select(F.col("node").alias("_n"), "_before"))
    way = W.partitionBy("key").orderBy("depth")
    placed = owned.select("key", "depth", "node", "length", "own").join(before, F.col("node") == F.col("_n"))
    placed = placed.withColumn("position", F.sum("length").over(way) - F.col("length"))
    placed = placed.withColumn("start", F.sum("_before").over(way) + F.col("position"))
    ways = placed.groupBy(F.col("key").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("depth", "start", "position", "own"))).alias("way"))
    # the ways of conversations that own nothing have done their part
    ways = ways.filter(F.exists("way", lambda t: t["own"]))
    out = f"key string, conv_id {kind}, copies long, depth int, node binary, parent binary, start long, position long, length long, ids binary, body_start int, body_length int, trained boolean, ancestors array<struct<start: long, end: long>>"
    nodes = known.join(ways, F.col("key") == F.col("_k")).drop("_k").mapInArrow(_emit(tokens.width), out)
    return PrefixTrees(nodes, owned.select("key", "conv_id", "copies", "depth", "node", "own"), tokens)


def read_back(trees: PrefixTrees) -> DataFrame:
    """conv_id, `formatted` (its segments from the root, decoded) and `trained` (texts under the loss mask), a row a conversation.

    Nodes that a conversation owns come with it; only those that it shares with their owner are looked up, in a table of
    shared nodes that is written first.
    """
    said = F.struct("depth", "ids", "body_start", "body_length", "trained")
    own = trees.nodes.select("key", "conv_id", "copies", said.alias("t"))
    others = trees.paths.filter("NOT own").select("key", "conv_id", "copies", F.col("depth").alias("_d"), F.col("node").alias("_n"))
    shared = written(others.select("_n").distinct().join(trees.nodes.select("node", "ids", "body_start", "body_length", "trained"), F.col("_n") == F.col("node")).drop("_n"))
    found = others.join(shared, F.col("_n") == F.col("node")).withColumnRenamed("_d", "depth").select("key", "conv_id", "copies", said.alias("t"))
    ways = own.union(found).groupBy("key", "conv_id", "copies").agg(F.array_sort(F.collect_list("t")).alias("way"))
    tokens, kind = trees.tokens, dict(trees.paths.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            formatted, masked = [], []
            for way in batch.column("way").to_pylist():
                formatted.append(tokens.decode(b"".join([t["ids"] for t in way])))
                body = [t["ids"][t["body_start"] * tokens.width : (t["body_start"] + t["body_length"]) * tokens.width] for t in way if t["trained"]]
                masked.append(list(map(tokens.decode, body)))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("copies"), pa.array(formatted, pa.string()), pa.array(masked, pa.list_(pa.string()))], names=["conv_id", "copies", "formatted", "trained"])

    read = ways.select("conv_id", "copies", "way").mapInArrow(run, f"conv_id {kind}, copies long, formatted string, trained array<string>")
    return read.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("conv_id", "formatted", "trained")


def digests(read: DataFrame) -> DataFrame:
    """What the formatted text says: turns, text under the loss mask, and their SHA-256."""
    kind = dict(read.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for formatted, trained in zip(batch.column("formatted").to_pylist(), batch.column("trained").to_pylist()):
                turns = read_turns(formatted)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                text = "".join(map(unescape, trained))
                values = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest(), len(formatted))
                for column, value in zip(out.values(), values):
                    column.append(value)
            arrays = [pa.array(v, pa.string() if n.endswith("sha256") else pa.int64()) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], names=["conv_id", *out])

    return read.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
