"""Operators against plain versions that share none of their plans, and texts of several megabytes through all of them."""

from __future__ import annotations

import base64
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quern.llm import chat, language_model, licenses, mixing, near_copies, packing, quality_classifier, quality_rules, sharding, simhash, topk
from quern.plans.rows import numbered
from tests.llm.test_text_operators import CHAT_TOKENS, DOCS, TOKENIZER, odd_docs


def plain_kept(text: str, min_words: int = 20) -> bool:
    raw = text.encode()
    words = raw.split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    if not raw or len(words) < min_words or 100 * len(repeated) > 30 * len(words):
        return False

    def fits(part: bytes) -> bool:
        for start, lo, hi in quality_rules.BANDS:
            if len(part) >= start:
                least, most = lo, hi
        return least <= len(zstandard.compress(part, 3)) / len(part) <= most

    outside = 0
    for i in range(0, len(raw), quality_rules.CHUNK):
        if not fits(raw[i : i + quality_rules.CHUNK]):
            outside += len(raw[i : i + quality_rules.CHUNK])
    return fits(raw) and outside / len(raw) <= quality_rules.CHUNK_SHARE


def prose(r: random.Random, n: int) -> str:
    """Words by a falling frequency, of syllables, with sentences."""
    sounds = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u", "an", "en", "er", "on")]
    vocabulary = ["".join(r.choices(sounds, k=r.choice((1, 1, 2, 2, 3)))) for _ in range(1500)]
    words = [vocabulary[min(1499, int(r.paretovariate(0.7)))] for _ in range(n)]
    return " ".join(w + "." if i % 11 == 10 else w for i, w in enumerate(words))


def noise(r: random.Random, size: int) -> str:
    return " ".join(base64.b64encode(r.randbytes(12)).decode()[:15] for _ in range(-(-size // 16)))[:size]


def test_verdicts_match_plain_ones(spark):
    r = random.Random(2)
    texts = [prose(r, n) for n in (1, 5, 19, 20, 25, 60, 150, 300, 700, 1500, 4000)]
    clean = len(texts)
    texts += [noise(r, n) for n in (300, 350, 400, 500, 640, 800, 1000, 1500, 2047, 5000)]
    junk = len(texts)
    # noise in the middle, at the tail, repetition in a tail of less than half a chunk, one long word
    texts += [prose(r, 300) + noise(r, 1800), prose(r, 130) + " " + noise(r, 900), prose(r, 180) + " ab" * 400, prose(r, 200) + " ab" * 9, "x" * 5000, "a b c d e f g h i j " * 9]
    texts += [prose(r, r.randrange(1, 400)) + noise(r, r.randrange(600)) for _ in range(60)]
    texts += ["spam and eggs " * n for n in (1, 2, 4, 30)] + [bytes(r.choices(range(97, 123), k=n)).decode() for n in (3, 15, 16, 40, 90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for least in (20, 1):
        got = {x.doc_id: x.kept for x in quality_rules.judge(df, min_words=least).collect()}
        assert got == {i: plain_kept(t, least) for i, t in enumerate(texts)}
    assert all(got[i] for i in range(clean)) and not any(got[i] for i in range(clean, junk))
    assert not any(got[junk + i] for i in (0, 1, 2, 4, 5)) and got[junk + 3]


def plain_mix(rows: list[tuple], blocks_of: int, entropy: float) -> tuple[dict, float]:
    """(doc_id, epoch) with source, start and block. `rows` has doc_id, source, text, and the hash of each pass."""
    tokens = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t, _ in rows}
    size = Counter()
    for d, s, _, _ in rows:
        size[s] += tokens[d]
    total = sum(size.values())
    used = [n for n in size.values() if n]

    def spread(a: float) -> float:
        w = [(n / total) ** a for n in used]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    lo, hi = 0.0, 1.0
    if spread(1.0) >= entropy * math.log(len(used)) - 1e-12:
        lo = 1.0
    else:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if spread(mid) >= entropy * math.log(len(used)) else (lo, mid)
    z = sum((n / total) ** lo for n in used)
    budget = total * z * (max(used) / total) ** (1 - lo)
    blocks = max(1, math.ceil(budget / blocks_of), math.ceil(len(rows) / mixing.BLOCK_ROWS))
    out = {}
    for s in size:
        mine = round((size[s] / total) ** lo / z * budget) if size[s] else 0
        mine = size[s] if abs(mine - size[s]) <= 1 else mine
        reached = []
        for epoch in range(max(1, math.ceil(mine / max(1, size[s])))):
            start = epoch * size[s]
            for h, d in sorted((hs[epoch] % 2**64, d) for d, s2, _, hs in rows if s2 == s):
                if start < mine or not size[s] or start == mine == (epoch + 1) * size[s]:
                    reached.append((d, epoch, start))
                start += tokens[d]
        for before, (d, epoch, start) in enumerate(reached):
            share = (start / max(1, mine) + before / len(reached)) / 2 if size[s] else before / len(reached)
            out[d, epoch] = (s, start, min(blocks - 1, math.floor(share * blocks)))
    return out, lo


def test_mixing_matches_a_plain_version(spark, tmp_path):
    r = random.Random(4)
    texts = [(i, "big", "w " * r.randrange(1, 30)) for i in range(500)] + [(500 + i, f"s{i % 3}", "w " * r.randrange(0, 9)) for i in range(90)]
    # one document with words among many without, and a source of nothing but those
    texts += [(1000 + i, "mostly empty", "w " * 700 if i == 77 else None if i % 2 else "") for i in range(900)] + [(3000 + i, None, " ") for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    passes = 40
    hashed = numbered(df, "doc_id", "source", "text").select("doc_id", "source", "text", F.array(*[F.xxhash64(F.lit(17), F.lit(e), "doc_id", "_row") for e in range(passes)])).collect()
    want, exponent = plain_mix([tuple(x) for x in hashed], 400, 0.9)
    got = mixing.mix(df, target_entropy=0.9, block_tokens=400).collect()
    assert got[0].exponent == pytest.approx(exponent, abs=1e-9)
    found = {(x.doc_id, x.epoch): (x.source, x.start, x.block) for x in got}
    assert len(found) == len(got) and found.keys() == want.keys() and max(e for _, e in found) < passes
    assert all(found[k][:2] == want[k][:2] for k in want) and sum(found[k][2] != want[k][2] for k in want) <= 2  # rounding at an edge
    blocks = Counter(x.block for x in got)
    mean = len(got) / len(blocks)
    assert len(blocks) > 20 and max(blocks.values()) < 4 * mean


@pytest.mark.parametrize("unit", [True, False])
def test_top_k_over_many_buckets(spark, monkeypatch, unit):
    """Repeated rows, ties and many buckets and blocks, against all products."""
    monkeypatch.setattr(topk, "BUCKET", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    g = np.random.default_rng(3)
    v = g.normal(size=(500, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if not unit:
        v *= np.exp(g.normal(size=500) * 1.5)[:, None]
    v[100:130] = v[100]
    rows = [(int(i % 450), x.tolist()) for i, x in enumerate(v)] + [(451, v[7].tolist())] * 7 + [(500, [0.0] * 6)]
    got = defaultdict(list)
    asked = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    for x in asked.orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    whole = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x in rows]
    for q in {i for i, _ in rows if i % 50 == 0}:
        mine = {tuple(x) for i, x in whole if i == q}
        best = sorted((-int(np.dot(m, x)), i) for m in mine for i, x in whole if i != q)[:5]
        assert got.pop(q) == [(i, -s) for s, i in best]
    assert not got


def test_sharding_matches_a_plain_version(spark, tmp_path):
    r = random.Random(6)
    rows = [(i % 700, None if i % 50 == 0 else "same" if i % 3 == 0 else "t" * r.randrange(200)) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    keyed = numbered(df, "doc_id", "text").select("doc_id", "text", "_row", F.xxhash64(F.lit(7), "doc_id", "_row").alias("key")).collect()
    buckets = math.ceil(sum(len(x.text or "") for x in keyed) / 5000)
    by = defaultdict(list)
    for x in keyed:
        by[x.key % buckets].append(x)
    order = []
    for b in range(buckets):
        mine = sorted(by[b], key=lambda x: (x.key, x._row))
        order += [mine[i] for i in np.random.default_rng([7, b]).permutation(len(mine))]
    want, small, more = [], 1000 // 13, 1000 % 13
    for shard in range(13):
        n = small + (shard < more)
        want += [(x.doc_id, x.text, shard, slot) for slot, x in enumerate(order[:n])]
        order = order[n:]
    got = sharding.shuffle_into_shards(df, 13, ["doc_id", "text"], bucket_bytes=5000).collect()
    key = lambda x: (x[2], x[3])
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)


def plain_ftrl(examples: list[tuple[dict, int]], order: list[int]) -> dict[int, float]:
    """Per-coordinate follow-the-regularised-leader with dictionaries."""
    q = quality_classifier
    z, n = defaultdict(float), defaultdict(float)

    def weight(i: int) -> float:
        if abs(z[i]) <= q.L1:
            return 0.0
        return (math.copysign(q.L1, z[i]) - z[i]) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for e in order:
        x, y = examples[e]
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * v for i, v in x.items())))))
        for i, v in x.items():
            g = (p - y) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    return {i: weight(i) for i in z}


def test_classifier_matches_plain_ftrl():
    r = random.Random(7)
    texts = [prose(r, r.randrange(1, 60)) if i % 2 else " | ".join("".join(r.choices("xyz", k=4)) for _ in range(r.randrange(1, 40))) for i in range(80)] + ["", "one", "one one", "a b c"]
    labels = [i % 2 for i in range(len(texts))]
    words, examples = quality_classifier._Words(), []
    for t, y in zip(texts, labels):
        x: dict[int, float] = defaultdict(float)
        at, weight = quality_classifier.features(t.encode(), words)
        for i, v in zip(at.tolist(), weight.tolist()):
            x[i] += v
        n = len(t.split())
        # a word, a pair, two kinds of shapes: each weighs 1 in all, and the intercept 1
        assert sum(x.values()) == pytest.approx(1 + (n > 0) + 2 * (n > 1) + (n > 2))
        examples.append((dict(x), y))
    order = np.random.default_rng(5)
    visits = [int(i) for _ in range(quality_classifier.EPOCHS) for i in order.permutation(len(examples))]
    want = plain_ftrl(examples, visits)
    got = quality_classifier._learn([t.encode() for t in texts], labels, 5)
    assert {i for i in np.flatnonzero(got)} == {i for i, w in want.items() if w}
    assert all(got[i] == pytest.approx(w, abs=1e-9) for i, w in want.items())


def test_features_are_those_of_the_words():
    """The places of words and pairs come from their hashes alone, wherever they stand."""
    q, words = quality_classifier, quality_classifier._Words()
    mask = (1 << 64) - 1

    def place(a: int, b: int, salt: int) -> int:
        return ((a * 0x9E3779B97F4A7C15 + b + salt) * 0xC2B2AE3D27D4EB4F & mask) >> (64 - q.BITS)

    parts = "the cat saw the cat".split()
    h = [zlib.crc32(w.encode()) for w in parts]
    want = [place(x, 0, 1) for x in h] + [place(x, y, 2) for x, y in zip(h, h[1:])]
    assert q.features(" ".join(parts).encode(), words)[0][:9].tolist() == want


def plain_shingles(text: str, size: int) -> list[tuple[str, ...]]:
    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", text.lower())
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def test_license_matches_against_plain_containment():
    """By sets of words alone: a stretch as long as the template that holds enough of it is found, and what is found is held."""
    templates = {**licenses.TEMPLATES, **{n: t for n, t in licenses.whole_texts().items() if n in ("apache-2.0-text", "cc0-1.0-text")}}
    classes = licenses.window_classes(templates)
    r = random.Random(9)
    texts = []
    for name in sorted(templates) * 2:
        words = templates[name].split()
        changed = [w if r.random() > 0.03 else f"edit{r.randrange(99)}" for w in words]
        lost = r.randrange(max(1, len(words) // 3))
        filler = [f"f{r.randrange(300)}" for _ in range(r.randrange(80))]
        texts.append(" ".join([*filler, *changed[lost:], *filler]))
    found = {(m[0], m[1]): m for m in licenses.scan_texts([t.encode() for t in texts], classes, licenses._Hashes())}
    must = 0
    for i, text in enumerate(texts):
        for name, template in templates.items():
            words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", template.lower())
            size = min(5, len(words))
            want, there = plain_shingles(template, size), plain_shingles(text, size)
            need, distinct = 0.8 * len(set(want)), set(want)
            length = len(want)
            if len(distinct & set(there)) < need - 1e-9:
                assert (i, name) not in found
                continue
            near = max(len(distinct & set(there[k : k + length])) for k in range(max(1, len(there) - length + 1)))
            if near >= need - 1e-9:
                must += 1
                assert (i, name) in found
            if (i, name) in found:
                _, _, share, first, end, _ = found[i, name]
                assert share == pytest.approx(len(distinct & set(plain_shingles(" ".join(re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", text.lower())[first:end]), size))) / len(distinct))
    assert must > 30


def test_templates_from_a_table(spark):
    rows = spark.createDataFrame([("own", "one two three four five six seven"), ("none", None)], "name string, text string")
    own = licenses.from_table(rows)
    docs = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "all rights reserved")], "doc_id int, text string")
    assert [(x.doc_id, x.license) for x in licenses.scan(docs, own).collect()] == [(1, "own")]
    with pytest.raises(ValueError):
        licenses.from_table(rows, 0)


def test_texts_of_megabytes(spark):
    """Several megabytes in one text, of one word, of distinct words and of one endless word."""
    r = random.Random(8)
    notice = licenses.TEMPLATES["isc-permission"]
    long = [prose(r, 500_000) + " " + notice, "w " * 2_000_000, "z" * 3_000_000, " ".join(f"w{i}" for i in range(400_000))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(long)] + [(9, "short text", "en", "s", 10)], DOCS)
    model = language_model.train(df, F.lit(True))
    scored = {x.doc_id: x for x in language_model.score(df, model).collect()}
    assert [scored[i].n_tokens for i in range(4)] == [len(t.split()) + 1 for t in long] and all(math.isfinite(x.score) for x in scored.values())
    kept = {x.doc_id: x for x in quality_rules.judge(df).collect()}
    assert kept[0].n_words == len(long[0].split()) and kept[0].kept and not kept[1].kept and not kept[2].kept
    assert kept[0].n_chunks == -(-len(long[0]) // quality_rules.CHUNK)
    assert [(x.doc_id, x.license) for x in licenses.scan(df).collect()] == [(0, "isc-permission")]  # the end of the longest
    assert mixing.mix(df, target_entropy=0.9).agg(F.sum("tokens")).first()[0] == sum(len(t.split()) for t in long) + 2
    assert {x.doc_id: x.component_id for x in simhash.near_duplicates(df).collect()}.keys() == {0, 1, 2, 3, 9}
    assert near_copies.keep_one(df, ("doc_id",)).count() == 5
    assert sharding.shuffle_into_shards(df, 2, ["doc_id", "text"]).agg(F.sum(F.length("text"))).first()[0] == sum(map(len, long)) + 10
    packed = packing.pack(packing.token_pieces(df, TOKENIZER, digest_only=True)).groupBy("doc_id").agg(F.sum("length"), F.max("length")).collect()
    assert len(packed) == 5 and all(x[2] <= 4096 for x in packed)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (9, 1)], "doc_id long, quality int")
    assert quality_classifier.score(df, quality_classifier.train(df, labels, F.lit(True))).count() == 5
    said = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(long)], "conv_id long, turn long, role string, text string")
    digest = chat.digests(chat.read_back(chat.prefix_trees(said, CHAT_TOKENS))).first()
    assert digest.n_turns == 4 and digest.loss_chars == len(long[1]) + len(long[3])


def test_odd_rows_stay_whole(spark):
    n = odd_docs(spark).count()
    assert quality_rules.judge(odd_docs(spark), min_words=1).count() == n
    assert {x.doc_id for x in mixing.mix(odd_docs(spark), target_entropy=0.9).collect()} >= {x.doc_id for x in odd_docs(spark).select("doc_id").collect()}
