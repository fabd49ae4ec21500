"""Aligned tokens against a plain version that encodes whole texts and walks over bytes."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import alignment, queries

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ODD = [None, "", " ", "  two  blanks ", "\nline\n\nline \n x", "a b", "a b  c", "<|endoftext|> <s> </s> <unk> <0x41>", "it's 12,3 ÀÉ ß İ 漢字 é K 🙂👍🏽", "▁ is a piece", "x ▁y", "é fi ﬁ Ⅷ", "x " * 3000, "same here", "same here", "\x00\x1f \x1d z", "tab\tand \t blank", "no" * 400]


def byte_level():
    """Byte of each character of a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTES = byte_level()
A_BYTES = {i: bytes(BYTES[c] for c in t) for t, i in A.get_vocab().items() if t != "<|endoftext|>"}


def tokens(text):
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text, num_threads=1)
    want = (" " + text).encode()
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    a_bytes = [A_BYTES[i] for i in a]
    if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return [], []
    return list(zip(a, map(len, a_bytes))), list(zip(b, map(len, b_bytes)))


def plain(docs):
    found, total = [], Counter()
    for doc_id, text in docs:
        a, b = tokens(text or "")
        ends, of = [], []
        for side in (a, b):
            at, last, where = 0, [], {}
            for n, (i, size) in enumerate(side):
                for k in range(size):
                    where[at + k] = (n, i)
                at += size
                last.append(at)
            ends.append(last)
            of.append(where)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, start = [], 0
        for cut in cuts:
            sides = [list(dict.fromkeys(where[k] for k in range(start, cut))) for where in of]
            groups.append("|".join(",".join(str(i) for _, i in side) for side in sides))
            start = cut
        links = {(of[0][k], of[1][k]) for k in range(start)}
        pairs = [(x[1], y[1]) for x, y in links]
        total.update(pairs)
        found.append((doc_id, len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return sorted([(d, na, nb, ng, len(p), sum(total[x] == most[x[1]] for x in p), sum(total[x] for x in p), sha) for d, na, nb, ng, p, sha in found], key=str)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows(frame):
    return sorted([tuple(r[n] for n in NAMES) for r in frame.collect()], key=str)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é▁\n\t 　1,.'s漢🙂<>|"), max_size=40))
def test_segments_give_the_ids_of_the_whole_text(text):
    t = alignment._tokenizers(*queries.ALIGNED)
    segments = t.segments(text)
    made = alignment._aligned(list(dict.fromkeys(segments)), t)
    a, b = tokens(text)
    places = {s: i for i, s in enumerate(dict.fromkeys(segments))}
    good = bool(text) and all(made["good"][places[s]] for s in segments)
    assert good == bool(a)
    if good:
        assert sum(made["n_a"][places[s]] for s in segments) == len(a)
        assert sum(made["n_b"][places[s]] for s in segments) == len(b)
        groups = b"".join(made["said"][places[s]] for s in segments)[:-1].decode().split(";")
        assert [int(i) for g in groups for i in g.split("|")[0].split(",")] == [i for i, _ in a]
        assert [int(i) for g in groups for i in g.split("|")[1].split(",")] == [i for i, _ in b]


@pytest.mark.parametrize("size", [16 << 20, 20])
def test_against_plain(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE_BYTES", size)
    docs = list(enumerate(ODD)) + [(3, "same here"), (None, "no id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("TEXT"), F.lit(2).alias("slice")).repartition(3)
    assert rows(alignment.align(frame, queries.ALIGNED, digest_only=True)) == plain(docs)


def test_groups_counts_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "unbelievable tokens"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in alignment.align(frame, queries.ALIGNED).collect()}
    assert got[2] == "" and got[1].count(";") >= 1
    counts = alignment.pair_counts(frame, queries.ALIGNED).collect()
    assert counts and all(r["count"] == 1 and r.best for r in counts)
    assert alignment.align(frame.filter("false"), queries.ALIGNED).count() == 0


def test_registered_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op13_align_tokenizers(spark, SF)) == plain(docs)


def test_rows_of_a_slice_are_small(spark):
    """A slice of 4 MB as one row made pages of a hundred such rows, and memory grew with a task's input."""
    docs = [(i, " ".join(f"w{i * j % 9973}" for j in range(400))) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    source = frame.select(F.col("doc_id").alias("_c0"), F.col("text").cast("binary").alias("_bytes"))
    made = alignment._slices(source, 1, queries.ALIGNED, True)[0]
    assert not [c for c, kind in made.dtypes if kind.startswith("array")]
    sizes = made.agg(*[F.max(F.length(c)).alias(c) for c, kind in made.dtypes if kind == "binary"]).first()
    assert max(sizes) <= alignment.PIECE_BYTES
    assert rows(alignment.align(frame, queries.ALIGNED, digest_only=True)) == plain(docs)
