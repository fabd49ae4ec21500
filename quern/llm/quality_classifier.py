"""Quality classifier: logistic regression on hashed word n-grams, learned with follow-the-regularised-leader.

Features are words and word pairs, and pairs and triples of word shapes (case, digits, punctuation, length, and
whether a word repeats the one before), hashed to 2^18 places and weighted by their share of the text. Learning takes
a bounded sample of labelled documents, dealt by hash to a few learners whose weights are averaged; scoring is one
sparse dot product a document, in a single pass without a shuffle.

Defined cases: null texts count as empty and score by the intercept; a null label or one given twice with different
values is not learned from; repeated rows are scored alike; without any usable label every score is 0.5; an empty
table gives no rows; other columns are left behind unless carried.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import held_out, map_texts, text_bytes
from quern.plans.columns import pick

BITS = 18
INTERCEPT = 1 << BITS
#: Labelled documents that are learned from, about; all where there are fewer.
MAX_TRAIN_ROWS = 8000
LEARNERS, EPOCHS = 6, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7
CACHE_WORDS = 400_000


def _shape(word: bytes) -> int:
    """Case, digits, end and length of a word in eight bits."""
    upper, lower = word != word.lower(), word != word.upper()
    end = word[-1:]
    tail = 0 if end.isalnum() or end >= b"\x80" else 3 if word[-2:] == end * 2 else 2 if end == b"," else 1
    case = 3 * upper - upper * lower if upper or lower else 0
    if upper and lower and not word[:1].isupper() and word[0] < 128:
        case = 1
    length = min(3, len(word) // 4)
    letters = any(c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in word)
    digits = any(48 <= c <= 57 for c in word)
    return case | tail << 2 | length << 4 | (not letters) << 6 | digits << 7


class _Words(dict):
    """A word's hash and shape in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        code = self[word] = crc32(word) << 8 | _shape(word)
        return code


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x >> np.uint64(64 - BITS)


def features(text: bytes, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and their weights; each of the four kinds of n-gram weighs 1 in all. The intercept comes last."""
    parts = text.split()
    n = len(parts)
    if not n:
        return np.array([INTERCEPT]), np.array([1.0])
    code = np.fromiter(map(words.__getitem__, parts), np.int64, n).view(np.uint64)
    h, shape = code >> np.uint64(8), code & np.uint64(255)
    shape[1:] |= (code[1:] == code[:-1]).astype(np.uint64) << np.uint64(8)
    zero = np.uint64(0)
    kinds = [_mix(h, zero, 1), _mix(h[:-1], h[1:], 2), _mix(shape[:-1], shape[1:], 3), _mix(shape[:-2] << np.uint64(9) | shape[1:-1], shape[2:], 4)]
    at = np.concatenate([*kinds, [np.uint64(INTERCEPT)]]).astype(np.int64)
    weight = np.concatenate([*(np.full(len(k), 1.0 / max(1, len(k))) for k in kinds), [1.0]])
    return at, weight


def _learn(texts: list[bytes], labels: list[int], seed: int) -> np.ndarray:
    """Per-coordinate FTRL over the examples in a seeded order, several times."""
    z, n = np.zeros(INTERCEPT + 1), np.zeros(INTERCEPT + 1)
    words = _Words()
    examples = []
    for text, y in zip(texts, labels):
        at, x = features(text, words)
        places, inverse = np.unique(at, return_inverse=True)
        examples.append((places, np.bincount(inverse, x), y))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in random.permutation(len(examples)):
            at, x, y = examples[i]
            w = weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(z, n)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS, seed: int = 5) -> np.ndarray:
    """Weights, 2^18 + 1 of them, from documents whose label is 0 or 1 and for which `usable` (of doc_id) holds."""
    marks = pick(labels, "doc_id", label).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    marks = marks.groupBy("doc_id").agg(F.min(label).alias("_y"), F.max(label).alias("_most")).filter("_y = _most").drop("_most")
    n = marks.count()
    if not n:
        return np.zeros(INTERCEPT + 1)
    share = min(1.0, max_rows / n)
    sample = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about max_rows rows of two numbers, whatever the size of the tables
    rows = pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(LEARNERS)).cast("int").alias("_learner"), F.col("_y").cast("int"), text_bytes().alias("_bytes"), "doc_id")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("_bytes", "ascending")])
        w = _learn(table.column("_bytes").to_pylist(), table.column("_y").to_pylist(), seed)
        return pa.table({"w": pa.array([w.astype("<f4").tobytes()], pa.binary())})

    parts = rows.groupBy("_learner").applyInArrow(learn, "w binary").collect()  # LEARNERS vectors of 1 MB
    if not parts:
        return np.zeros(INTERCEPT + 1)
    return np.mean([np.frombuffer(r["w"], "<f4") for r in parts], axis=0)


def score(docs: DataFrame, weights: np.ndarray, carry: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns, score double and predicted int of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))  # 2 MB, fixed
    words: list[_Words] = []

    def per_batch(texts: list[bytes]) -> dict[str, list]:
        if not words:
            words.append(_Words())
        w = shared.value
        margins = np.array([float(w[at] @ x) for at, x in (features(t, words[0]) for t in texts)])
        scores = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
        return {"score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    return map_texts(docs, list(carry), "score double, predicted int", per_batch)


def is_held_out() -> Column:
    """Documents never learned from: crc32 of the id leaves 2 modulo 4."""
    return held_out(4, 2)
