"""The pipeline on a small corpus against a plain version of each stage."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm.packing import WordIds
from quern.llm.queries import queries
from tests.llm.test_plain_versions import plain_kept
from tests.llm.test_text_operators import DOCS, plain_fingerprint


def corpus(folder: str, spark) -> dict[int, tuple[str, str, bool]]:
    r = random.Random(12)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(900)]
    rows, labels, kept = [], [], {}
    for i in range(260):
        kind = "table" if i % 5 == 0 else "spam" if i % 11 == 0 else "good"
        text = {
            "good": lambda: " ".join(r.choices(words, k=r.randrange(60, 200))),
            "table": lambda: " | ".join(r.choices(words, k=90)),
            "spam": lambda: " ".join(r.choices(words, k=3)) * 60,
        }[kind]()
        source = "big" if i % 3 else f"s{i % 2}"
        rows.append((i, text, "en", source, len(text)))
        labels.append((i, int(kind == "good"), 0))
        kept[i] = (kind, text, source)
    copies = [(1000 + i, kept[i][1], "en", kept[i][2], len(kept[i][1])) for i in range(60)]
    odd = [(2000, None, None, None, None), (2001, "", "en", "big", 0), (None, "short", "en", None, 5)]
    spark.createDataFrame(rows + copies + odd, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return kept


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    known = corpus(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = {r.doc_id: r.text for r in docs.collect()}
    tables = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        tables.append(docs.collect())
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ruled, good, single, mixed, packed = tables

    assert {r.doc_id for r in ruled} == {i for i, t in whole.items() if plain_kept(t or "", min_words=1)}
    assert None in {r.doc_id for r in ruled}, "a short text is no reason to go"
    assert not any(known.get((r.doc_id or 0) % 1000, ("", ""))[0] == "spam" for r in ruled)

    kind = lambda i: "short" if i is None else known[i % 1000][0]
    kinds = Counter(kind(r.doc_id) for r in good)
    assert kinds["good"] == sum(kind(r.doc_id) == "good" for r in ruled) and kinds["table"] <= 1

    reach = {r.doc_id: plain_fingerprint(r.text) for r in good}
    first = {}
    for i in sorted(reach, key=lambda i: -1 if i is None else i):
        first.setdefault(reach[i], i)
    near = [(a, b) for a in first for b in first if a < b and (a ^ b).bit_count() <= 2]
    assert not near, "random texts have no near copies but the planted ones"
    assert len(single) == len(first) and {r.doc_id for r in single} == set(first.values())

    times = Counter(r.doc_id for r in mixed)
    assert set(times) == set(first.values())
    assert all(r.text == whole[r.doc_id] for r in mixed)

    table = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in mixed:
        want[r.doc_id] += len(table.tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for p in packed:
        got[p.doc_id] += p.length
    assert got == want
    assert len({p.sequence_id for p in packed}) == -(-sum(want.values()) // 4096)
    # which documents a partial pass reaches depends on the files; which documents there are doesn't
    again = corpus_pipeline.run(spark, folder).select("doc_id").distinct()
    assert {r.doc_id for r in again.collect()} == set(got)


def runs(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_pairs(rows) -> dict[int, int]:
    """Each place in `rows` and the smallest place of its class, by all pairs."""
    sets = [runs(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(rows))}


def test_near_copies_go(spark, monkeypatch):
    """Copies with a few words changed: chains and a large group, at similarities around 0.8, in cells of many sizes."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(900)]
    texts = [" ".join(r.choices(words, k=r.randrange(60, 300))) for _ in range(50)]

    def changed(text: str, n: int) -> str:
        parts = text.split()
        for i in r.sample(range(len(parts)), n):
            parts[i] = r.choice(words)
        return " ".join(parts)

    texts += [changed(t, n) for t in texts[:12] for n in (1, 2, 4)]
    texts += [changed(t, 1).upper() for t in texts[50:60]]
    texts += [changed(texts[20], 1) for _ in range(40)] + ["", None, " ", "a b", "A  b", "a c", "a b c d e", "a b c d e a b c d e"]
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(7, texts[7], "en", "s", 1)] * 2, DOCS)
    listed = rows.collect()
    classes = near_pairs(listed)
    want = sorted({listed[i].doc_id for i in classes.values()})
    assert len(want) < len(texts) - 60
    for cell in (512, 6):
        monkeypatch.setattr(corpus_pipeline.near_copies, "CELL", cell)
        assert sorted(x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()) == want
    assert corpus_pipeline.drop_near_duplicates(spark, rows.limit(0), "").count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_usable_label_drops_nothing(spark, tmp_path):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(900)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=80)), "en", "s", 1) for i in range(12)] + [(None, None, None, None, None)], DOCS)
    held = next(i for i in range(12) if zlib.crc32(str(i).encode()) % 4 == 2)
    free = next(i for i in range(12) if zlib.crc32(str(i).encode()) % 4 != 2)
    for n, labels in enumerate(([], [(held, 1, 0)], [(free, None, 0)], [(free, 0, 0), (free, 1, 0)], [(99, 1, 0)])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        kept = corpus_pipeline.apply_classifier(spark, docs, f"{tmp_path}/{n}")
        assert kept.columns == docs.columns and kept.count() == 13


def test_registered_queries(spark):
    """Each query runs over the smallest tables and says what its contract says."""
    sf = "/root/testdata/sf0.001"
    out = {n: f(spark, sf) for n, f in queries().items()}
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    sharded = out["op10_shuffle_shards"].collect()
    assert len(sharded) == n and {r.law for r in sharded} == {"rows"}
    per = Counter(r.shard for r in sharded)
    assert max(per.values()) - min(per.values()) <= 1
    lm = out["op2_lm_scores"].collect()
    held = [r for r in lm if r.held_out]
    assert len(lm) == n and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert out["op5_near_duplicates"].filter(F.length("fingerprint") == 16).count() == n
    pieces = out["op3_pack_sequences"].collect()
    assert len({p.sequence_id for p in pieces}) <= -(-sum(p.length for p in pieces) // 4096) + 1
    assert out["op7_chat_format"].filter("conv_id = -1 AND n_turns = 2 AND loss_chars = 21").count() == 1
