"""Operators that work on one text at a time, against plain versions; whole-corpus ones on edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import chat, language_model, licenses, mixing, packing, quality_classifier, quality_rules, sharding, simhash, topk

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CHAT_TOKENS = chat.tokens_of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "one", "Two words", "a b c", "<|endoftext|> it's 12,3 ÀÉ ß İ ΟΔΟΣ 漢字 é K", "x " * 9000, "same text here now", "same text here now", "line a b\nline a b\nline a b\n \n \n" * 9]


def odd_docs(spark):
    """Nulls anywhere, empty and long texts, repeated rows, and columns whose names clash."""
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(ODD)] + [(3, "one", "en", "s0", 1)] * 2 + [(None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    extra = [F.lit(i).alias(n) for i, n in enumerate(("TEXT", "shard", "slot", "kept", "score", "fp", "piece", "length", "_row", "epoch", "bucket", "ids"))]
    return df.select("*", *extra)


def empty(spark):
    return spark.createDataFrame([], DOCS)


words = st.lists(st.sampled_from(["a", "B", "cc", "|", "é", "x#y", "\n", "\n\n"]), max_size=60)


@settings(max_examples=60, deadline=None)
@given(words)
def test_rule_counts_match_plain_ones(parts):
    text = " ".join(parts)
    tokens = text.encode().split()
    windows = Counter(tuple(tokens[i : i + 8]) for i in range(len(tokens) - 7))
    covered = {i + j for i in range(len(tokens) - 7) if windows[tuple(tokens[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.split()]
    got = quality_rules._measure([text.encode()])
    assert got["n_repeat_words"][0].as_py() == len(covered)
    assert got["n_dup_lines"][0].as_py() == len(lines) - len(set(lines))
    assert got["word_chars"][0].as_py() == sum(len(w.decode()) for w in tokens)
    assert got["n_symbols"][0].as_py() == sum(c in "#*$%&|<>" for c in text)


def test_rules(spark):
    good = " ".join(random.Random(1).choices("alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omikron".split(), k=400))
    noise = "".join(chr(33 + random.Random(i).randrange(90)) + (" " if i % 7 == 0 else "") for i in range(3000))
    rows = spark.createDataFrame([(1, good), (2, "spam words " * 300), (3, noise), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(rows).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and not got[4].kept
    assert got[2].base_failed and not got[3].base_failed and got[4].n_words == 0 and got[4].ratio is None
    assert quality_rules.judge(odd_docs(spark)).count() == len(ODD) + 3 and quality_rules.judge(empty(spark)).count() == 0


def test_word_ids_match_the_tokenizer():
    table = packing.WordIds(TOKENIZER)
    for text in filter(None, ODD):
        assert table.encode(text.encode()) == np.array(table.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece(histogram):
    steps = packing.plan(histogram, 64)
    assert sum(n * c for n, _, c, _, _ in steps) == sum(n * c for n, c in histogram.items())
    places: dict[int, list[tuple[int, int]]] = {}
    ranks = Counter()
    for n, rank, count, first, offset in steps:
        assert rank == ranks[n]
        ranks[n] += count
        for i in range(first, first + count):
            places.setdefault(i, []).append((offset, n))
    assert ranks == Counter(histogram)
    assert set(places) == set(range(len(places)))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64 and sum(3 * n > 64 for _, n in spans) <= 2
    # no worse than first fit decreasing is known to be
    least = -(-sum(n * c for n, c in histogram.items()) // 64)
    assert len(places) <= 11 / 9 * max(least, sum(c for n, c in histogram.items() if n > 32)) + 40


def test_packing(spark):
    pieces = packing.token_pieces(odd_docs(spark), TOKENIZER, capacity=256)
    packed = packing.pack(pieces, 256).collect()
    whole = {}
    for r in packed:
        whole.setdefault(r.doc_id, set()).add((r.piece, r.start, tuple(r.ids)))
        assert len(r.ids) == r.length <= 256
    table = packing.WordIds(TOKENIZER)
    for i, text in enumerate(ODD):
        ids = [j for p in sorted(whole[i]) for j in p[2]]
        assert ids == [*table.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert all(p[1] == p[0] * 256 for p in whole[i])
    spans: dict[int, list] = {}
    for r in packed:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))]
    assert len(spans) == -(-sum(r.length for r in packed) // 256)
    digests = packing.token_pieces(odd_docs(spark), TOKENIZER, capacity=256, digest_only=True).filter("doc_id = 7").collect()
    assert {(r.piece, r.ids_crc32) for r in digests} == {(p[0], zlib.crc32(np.array(p[2], "<u4").tobytes())) for p in whole[7]}
    assert packing.pack(packing.token_pieces(empty(spark), TOKENIZER)).count() == 0


def plain_fingerprint(text: str) -> int:
    from xxhash import xxh64_intdigest

    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hs = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=60, deadline=None)
@given(words)
def test_fingerprint(parts):
    assert simhash.fingerprint(" ".join(parts).encode()) == plain_fingerprint(" ".join(parts))


def test_near_duplicates(spark):
    r = random.Random(3)
    base = [r.choices([f"w{i}" for i in range(300)], k=120) for _ in range(12)]
    texts = [*ODD]
    for b in base:
        for _ in range(8):
            c = list(b)
            for _ in range(r.randrange(3)):
                c[r.randrange(120)] = "edit"
            texts.append(" ".join(c))
    df = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string")
    fps = [plain_fingerprint(t or "") for t in texts]
    reach = list(range(len(texts)))
    for _ in texts:
        new = [min(reach[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
        if new == reach:
            break
        reach = new
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()}
    assert got == {i + 10: (f"{fps[i]:016x}", reach[i] + 10) for i in range(len(texts))}
    kept = simhash.keep_one(df, ("doc_id", "text"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, c in got.values()})
    odd = simhash.keep_one(odd_docs(spark), ("doc_id", "text")).collect()
    assert len(odd) == len({plain_fingerprint(t or "") for t in [*ODD, "no id"]})
    assert simhash.near_duplicates(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(df.select(F.col("doc_id").alias("fp")), 3)


def test_ball_links_all_close_pairs(spark):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        fps |= {f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(5)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert all((a ^ b & (2**64 - 1)).bit_count() <= 64 and a < b for a, b in got)
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[root(a)] = root(b)
    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                assert root(a) == root(b)


def test_top_k(spark):
    random_ = np.random.default_rng(1)
    rows = [(i, (random_.normal(size=8) * (1 + i % 5)).tolist()) for i in range(400)]
    rows += [(400, None), (401, [float("nan")] * 8), (402, [1.0, None] + [0.0] * 6), (403, [float("inf")] + [0.0] * 7), (404, []), (405, [3.0]), (406, rows[7][1]), (None, [1.0] * 8), (450, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("BUCKET", F.lit(1)).withColumn("score", F.lit(2))
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors[i] = [int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v))
    for q in [i for i in vectors if i % 50 == 0]:
        best = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:5]
        assert got.pop(q) == {n: (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert not got
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_repeated_rows(spark):
    """Each row is a candidate: six equal ones fill the five ranks, two leave three to others."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 1.0])] + [(1, [9.0, 0.0])] * 6 + [(2, [0.0, 5.0])] * 2 + [(i, [1.0, i / 10]) for i in range(3, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, v in rows[1:3]:
        best = sorted((-sum(int(256 * a // 1) * int(256 * b // 1) for a, b in zip(v, w)), i) for i, w in rows if i != q)[:5]
        assert got[q] == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert [i for _, i, _ in got[0]] == [1] * 5 and [i for _, i, _ in got[50]][:2] == [2, 2]


@pytest.mark.parametrize("sharp", [0.0, 0.6, 2.0])
def test_pruning_keeps_the_best(monkeypatch, sharp):
    monkeypatch.setattr(topk, "COORDINATE_FROM", sharp)
    monkeypatch.setattr(topk, "STEP", 64)
    r = np.random.default_rng(2)
    centres = r.normal(size=(5, 16)) * 50
    p = np.floor(centres[r.integers(0, 5, 700)] + r.normal(size=(700, 16)) * 6)
    q = np.floor(centres[r.integers(0, 5, 40)] + r.normal(size=(40, 16)) * 6)
    found = topk.search_cell(np.arange(700), p, np.arange(1000, 1040), q, np.full(40, -np.inf), 5)
    for i in range(40):
        scores = (p @ q[i]).astype(int)
        best = sorted((-s, j) for j, s in enumerate(scores.tolist()))[:5]
        assert sorted((-s, v) for qid, v, s in found if qid == 1000 + i) == best


def test_chat(spark):
    said = "</s>[INST] ok [/INST] <|turn|> <\\|end|> <<SYS>>\\"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", said), (2, 3, "assistant", said), (3, 0, "user", "hi"), (3, 1, "assistant", "other")]
    rows += [(4, 0, "user", None), (4, None, None, "x"), (None, 0, "assistant", "alone"), (None, 3, "assistant", "alone"), (None, None, "user", "alone"), (5, 1, "assistant", "b"), (5, 1, "assistant", "b"), (5, 0, "<|text|>", ""), (6, 0, "user", "hi"), (6, 1, "assistant", "yo")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("NODE", F.lit(1)).withColumn("start", F.lit(1))
    trees = chat.prefix_trees(df, CHAT_TOKENS)
    nodes = trees.nodes.collect()
    read = chat.read_back(trees)
    formatted = {r.conv_id: r.formatted for r in read.collect()}
    assert sorted(r.conv_id or 0 for r in read.collect()) == [0, 0, 0, 1, 2, 3, 4, 5, 6]
    assert chat.read_turns(formatted[2]) == [("user", "hi"), ("assistant", "yo"), ("user", said), ("assistant", said)]
    assert formatted[1] == formatted[6] and chat.read_turns(formatted[4]) == [("", "x"), ("user", "")]
    # one node for each different beginning, laid end to end without gaps
    assert len(nodes) == 2 + 2 + 1 + 2 + 2 + 3
    at = 0
    for n in sorted(nodes, key=lambda n: n.start):
        assert n.start == at
        at += n.length
    by = {bytes(n.node): n for n in nodes}
    for n in nodes:
        assert n.length * CHAT_TOKENS.width == len(n.ids) and CHAT_TOKENS.decode(bytes(n.ids)).startswith(chat.TURN)
    for r in trees.training_rows().collect():
        n = by[bytes(r.node)]
        assert r.token_ids == CHAT_TOKENS.ids(bytes(n.ids)).tolist() and r.position_ids == list(range(n.position, n.position + n.length))
        assert sum(r.loss_mask) == (n.body_length if n.trained else 0)
    for n in nodes:
        inside, up = 0, n.parent
        covered = {x for s in n.ancestors for x in range(s.start, s.end)}
        while up:
            inside += by[bytes(up)].length
            assert set(range(by[bytes(up)].start, by[bytes(up)].start + by[bytes(up)].length)) <= covered
            up = by[bytes(up)].parent
        assert n.position == inside == len(covered)
        # children lie behind their parent, before anything of another branch
        assert n.parent is None or by[bytes(n.parent)].start < n.start
    got = {r.conv_id: r for r in chat.digests(read).collect()}
    assert got[2].n_turns == 4 and got[2].loss_chars == len("yo" + said) and sorted(r.loss_chars for r in chat.digests(read).collect() if r.conv_id is None) == [0, 5, 5] and got[5].n_turns == 3
    assert chat.digests(chat.read_back(chat.prefix_trees(df.limit(0), CHAT_TOKENS))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "x", "|", "SYS>>"]), max_size=8))
def test_escaping_is_reversible(parts):
    text = "".join(parts)
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    segment = "".join(chat.format_turn(text, text))
    assert chat.read_turns(segment * 2) == [(text, text)] * 2
    assert CHAT_TOKENS.decode(CHAT_TOKENS.encode(segment)) == segment
    assert CHAT_TOKENS.ids(CHAT_TOKENS.encode(segment)).tolist() == CHAT_TOKENS._encoding.encode_ordinary(segment)


def test_sharding(spark):
    docs = odd_docs(spark)
    got = sharding.shuffle_into_shards(docs, 4, ["doc_id", "text"], bucket_bytes=500).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([*enumerate(ODD), (3, "one"), (3, "one"), (None, "no id")])
    slots: dict[int, list[int]] = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(4)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(ODD) + 3
    assert sharding.shuffle_into_shards(empty(spark), 4, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(docs, 4, ["shard"])


def test_written_shards_are_read_back(spark, tmp_path):
    docs = odd_docs(spark)
    placed = sharding.shuffle_into_shards(docs, 3, ["doc_id", "text"], bucket_bytes=500)
    sharding.write_shards(placed, str(tmp_path / "s"))
    back = sharding.read_shards(spark, str(tmp_path / "s"), placed.schema)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "text", "shard", "slot").collect()), key=str)
    assert rows(back) == rows(placed) and back.schema == placed.schema
    none = sharding.shuffle_into_shards(empty(spark), 3, ["doc_id", "text"])
    sharding.write_shards(none, str(tmp_path / "e"))
    assert sharding.read_shards(spark, str(tmp_path / "e"), none.schema).count() == 0


def test_shards_are_written_and_mixed(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.shuffle_into_shards(df, 7, ["doc_id"], bucket_bytes=300)
    sharding.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(3000))
    means = [r[0] for r in back.groupBy("shard").agg(F.avg("doc_id")).select("avg(doc_id)").collect()]
    assert all(abs(m - 1500) < 250 for m in means)
    again = sharding.shuffle_into_shards(df, 7, ["doc_id"], bucket_bytes=300)
    first = {r.doc_id: (r.shard, r.slot) for r in back.collect()}
    assert len(first) == again.count()


def test_mixing(spark):
    rows = [(i, "w " * 10, "big" if i < 600 else f"s{i % 4}") for i in range(760)] + [(1000, None, None), (1001, "", None), (1002, "x y", "tiny"), (1002, "x y", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("EPOCH", F.lit(1))
    got = mixing.mix(df, repetition_limit=2.0, block_tokens=500).collect()
    tokens: Counter = Counter()
    for r in got:
        tokens[r.source] += r.tokens
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert Counter(r.doc_id for r in got if r.source == "big") == Counter(range(600))
    # the smallest source sets the exponent: it is repeated as often as the limit allows, and no source more often
    assert tokens["tiny"] <= 2 * 4 + 2 and all(tokens[f"s{i}"] <= 2 * 400 + 10 for i in range(4))
    assert tokens["tiny"] == 8
    total = 6000 + 1600 + 4
    weights = {r.source: (r.weight, r.exponent) for r in got}
    a = weights["big"][1]
    z = sum((n / total) ** a for n in (6000, 400, 400, 400, 400, 4))
    assert weights["big"][0] == pytest.approx((6000 / total) ** a / z)
    slots: dict[int, list[int]] = {}
    for r in got:
        slots.setdefault(r.block, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    starts: dict[tuple, list] = {}
    for r in got:
        if r.source == "s1":
            starts.setdefault(r.epoch, []).append((r.start, r.tokens))
    for epoch, s in starts.items():
        at = epoch * 400
        for start, n in sorted(s):
            assert start == at
            at += n
    share = Counter()
    for r in got:
        if r.source == "big" and r.block < max(slots):
            share[r.block] += r.tokens
    assert max(share.values()) - min(share.values()) <= 40
    assert mixing.mix(empty(spark), target_entropy=0.9).count() == 0
    carried = mixing.mix(odd_docs(spark), target_entropy=0.9, carry=("text", "lang")).collect()
    assert {r.doc_id for r in carried} == {*range(len(ODD)), None}


def test_entropy_target(spark):
    sizes = spark.createDataFrame([("a", 1, 900), ("b", 1, 90), ("c", 1, 10)], "source string, n_docs long, n_tokens long")
    t = mixing.find_temperature(sizes, target_entropy=0.8)
    p = np.array([0.9, 0.09, 0.01]) ** t.exponent
    p /= p.sum()
    assert -(p * np.log(p)).sum() == pytest.approx(0.8 * np.log(3), abs=1e-6)
    assert mixing.find_temperature(sizes, target_entropy=0.0).exponent == 1
    assert mixing.find_temperature(sizes, repetition_limit=1e9).exponent == 0
    with pytest.raises(ValueError):
        mixing.find_temperature(sizes)


def test_license_scan(spark):
    filler = " ".join(random.Random(4).choices([f"word{i}" for i in range(200)], k=700))
    notice = licenses.TEMPLATES["mit-permission"].split()
    edited = notice[:20] + ["changed"] + notice[21:]
    half = notice[: len(notice) // 2]
    texts = [f"{filler} {' '.join(edited)} {filler}", f"{filler} {' '.join(half)} {filler}", f"x\nReleased under the MIT License.\n{filler}", "ALL RIGHTS RESERVED", None, "", f"{licenses.TEMPLATES['gpl-3.0-notice']}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license", F.lit(1))
    got = {(r.doc_id, r.license): r for r in licenses.scan(df).collect()}
    assert set(got) == {(0, "mit-permission"), (2, "mit-statement"), (3, "all-rights-reserved"), (6, "gpl-3.0-notice")}
    assert got[0, "mit-permission"].containment >= 0.8 and abs(got[0, "mit-permission"].first_word - 700) < 8
    assert licenses.scan(empty(spark)).count() == 0 and licenses.scan(df, {}).count() == 0


def test_license_bands_find_what_windows_hold():
    """All windows by brute force against the bands, on texts with pieces of templates."""
    classes = licenses.window_classes(licenses.TEMPLATES)
    table = licenses._Hashes()
    r = random.Random(6)
    names = sorted(licenses.TEMPLATES)
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts += [f"f{r.randrange(500)}" for _ in range(r.randrange(60))]
            w = licenses.TEMPLATES[r.choice(names)].split()
            cut = r.randrange(0, max(1, len(w) // 4))
            parts += w[cut:] if r.random() < 0.5 else w[: len(w) - cut]
        texts.append(" ".join(parts).encode())
    found = {(m[0], m[1]): m[2] for m in licenses.scan_texts(texts, classes, table)}
    for i, text in enumerate(texts):
        tokens = licenses.license_words(text)
        for c in classes:
            hashes = licenses.shingle_hashes(tokens, c.size, table)
            last = max(1, -(-(len(hashes) - c.window) // c.stride) + 1) if len(hashes) else 0
            for name, s in zip(c.names, c.sets):
                best = max((len(set(hashes[k * c.stride : (k + c.blocks) * c.stride].tolist()) & set(s.tolist())) / len(s) for k in range(last)), default=0)
                assert ((i, name) in found) == (best >= 0.8 - 1e-9)
                if best >= 0.8:
                    assert found[i, name] == pytest.approx(best)


def plain_kneser_ney(train: list[str], texts: list[str], order: int):
    """Scores by dictionaries of whole runs of words."""
    tokens = [[*t.encode().lower().split(), b"\n"] for t in train]
    windows = lambda t: [tuple([*[b"\n"] * (order - 1), *t][i : i + order]) for i in range(len(t))]
    counts: dict[int, Counter] = {order: Counter(w for t in tokens for w in windows(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(w[1:] for w in counts[k + 1])
    unigrams = Counter(w for t in tokens for w in t)
    by = lambda c: [sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]
    discount = {k: [0, *language_model.discounts(by(c))] for k, c in counts.items()}
    context: dict[int, dict] = {}
    for k, c in counts.items():
        context[k] = {}
        for w, n in c.items():
            total, often = context[k].setdefault(w[:-1], (Counter(), Counter()))
            total[()] += n
            often[min(n, 3)] += 1

    def p(run: tuple) -> float:
        k = len(run)
        lower = p(run[1:]) if k > 1 else 1 / (len(unigrams) + 1)
        if run[:-1] not in context[k]:
            return lower
        total, often = context[k][run[:-1]]
        n = counts[k][run]
        return (max(n - discount[k][min(n, 3)], 0) + sum(discount[k][j] * often[j] for j in (1, 2, 3)) * lower) / total[()]

    out = []
    for t in texts:
        ws = [*t.encode().lower().split(), b"\n"]
        base = sum(np.log10((unigrams[w] + 1) / (sum(unigrams.values()) + len(unigrams) + 1)) for w in ws)
        out.append((len(ws), sum(unigrams[w] > 0 for w in ws), base, sum(np.log10(p(w)) for w in windows(ws))))
    return out, p, unigrams


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, order):
    r = random.Random(8)
    vocabulary = [f"w{int(r.paretovariate(0.8)) % 80}" for _ in range(400)]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(0, 50))) for _ in range(120)] + ["", "Unseen WORDS here", "W1 w2", "w1 " * 900]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "w1 w2 w1"), (500, None)], "doc_id long, text string").withColumn("N_TOKENS", F.lit(0))
    learn = F.coalesce(F.col("doc_id"), F.lit(1)) % 3 != 0
    model = language_model.train(df, learn, order, shard_tokens=500, shard_bytes=900)
    got = {x.doc_id: x for x in language_model.score(df, model).collect()}
    train = [t for i, t in enumerate(texts) if i % 3] + ["w1 w2 w1", ""]
    expected, p, unigrams = plain_kneser_ney(train, texts, order)
    assert model.shards > 1 and model.vocabulary.bits > 2 and model.vocabulary.tokens == sum(unigrams.values())
    for i, (n, known, base, score) in enumerate(expected):
        assert (got[i].n_tokens, got[i].n_known) == (n, known)
        assert got[i].base_score == pytest.approx(base, abs=1e-9) and got[i].score == pytest.approx(score, abs=1e-9)
    # probabilities of all known words and the unknown one sum to 1 after any context
    for a in (b"w1", b"\n", b"never"):
        run = (b"w1",) * (order - 2) + (a,)
        assert sum(p((*run, w)) for w in unigrams) + p((*run, b"never seen")) == pytest.approx(1)
    model._files.most, model.vocabulary._files.most = 1, 2  # a worker that may hold few maps scores alike
    assert {x.doc_id: x for x in language_model.score(df, model).collect()} == got
    nothing = language_model.train(df, F.lit(False), order)
    assert all(x.score == 0 and x.base_score == 0 for x in language_model.score(df, nothing).collect())
    assert language_model.score(empty(spark), model).count() == 0
    with pytest.raises(ValueError):
        language_model.train(df, learn, 1)


def test_classifier(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 > 0
        text = " ".join("".join(r.choices("abcdefg", k=r.randrange(2, 8))) for _ in range(80)) if good else " | ".join("".join(r.choices("abcdefg", k=4)) for _ in range(60))
        rows.append((i, text))
        labels.append((i, int(good)))
    labels += [(0, 1), (1, None), (None, 1)]
    df = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string").withColumn("Score", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality_classifier.train(df, marks, ~quality_classifier.is_held_out())
    got = {x.doc_id: x for x in quality_classifier.score(df, weights).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(got[i].predicted == int(i % 4 > 0) for i in held)
    assert right / len(held) > 0.97 and 0 <= got[900].score <= 1 and got[900].score == got[901].score
    none = quality_classifier.train(df, marks.limit(0), ~quality_classifier.is_held_out())
    assert {x.score for x in quality_classifier.score(df, none).collect()} == {0.5}
    assert quality_classifier.score(odd_docs(spark), weights).count() == len(ODD) + 3
    assert quality_classifier.score(empty(spark), weights).count() == 0
