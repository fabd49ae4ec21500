"""Compression bands: zstandard ratios of whole documents and of fixed chunks, within limits for their length.

Text that compresses too well is repetitive, text that hardly compresses is noise. The limits widen as texts get
shorter, since a short text gives the compressor little to work on. Every chunk is judged by the band of its own length,
the last one too, and a text fails if chunks outside their bands make up too large a share of its bytes. Simple counts
go along: words, symbols, repeated lines and words inside repeated eight-word windows, with the two base rules on them.

Defined cases: null counts as empty; a text without words has zero counts and fails the base rules; repeated rows
are judged alike, each on its own; a text of any length is judged whole; an empty table gives no rows; other columns are
left behind unless carried.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.text import map_texts

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: From so many bytes on, the least and the largest ratio of compressed to raw bytes. Prose lies well inside: at 1 KB
#: near 0.55, at 64 KB near 0.4. Up to 128 bytes the frame of the compressor hides whether text is noise.
BANDS = (
    (0, 0.0, float("inf")), (16, 1.15, float("inf")), (32, 0.75, float("inf")), (64, 0.50, float("inf")), (128, 0.40, 1.00), (160, 0.38, 0.94), (192, 0.36, 0.90), (256, 0.33, 0.86),
    (384, 0.30, 0.82), (512, 0.28, 0.79), (768, 0.26, 0.74), (1024, 0.24, 0.71), (2048, 0.22, 0.65), (4096, 0.20, 0.59), (16384, 0.18, 0.57), (65536, 0.16, 0.57),
)
#: Bytes of a chunk, and the share of a text's bytes that may lie in chunks outside their bands.
CHUNK, CHUNK_SHARE = 1024, 0.25
MIN_WORDS = 20
LEVEL = 3
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, n_chunks long, n_bad_chunks long, kept boolean"
)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words found twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    order = np.argsort(mixed, kind="stable")
    twins = mixed[order[1:]] == mixed[order[:-1]]
    if not twins.any():
        return 0
    at = np.zeros(n, bool)
    at[order[1:][twins]] = True
    at[order[:-1][twins]] = True
    # hashes found candidates; the windows themselves decide
    found = np.flatnonzero(at).tolist()
    windows = [tuple(words[i : i + size]) for i in found]
    count = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(found, windows):
        if count[w] > 1:
            covered[i] += 1
            covered[i + size] -= 1
    return int((np.cumsum(covered) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    repeats = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip(WHITE):
            seen.add(line)
    return repeats


def _code_points(text: bytes) -> int:
    raw = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def band(length: int) -> tuple[float, float]:
    """Least and largest ratio for a text of `length` bytes."""
    return next((lo, hi) for start, lo, hi in reversed(BANDS) if length >= start)


def _inside(size: int, compressed: int) -> bool:
    lo, hi = band(size)
    return lo * size <= compressed <= hi * size


def _measure(texts: list[bytes], min_words: int = MIN_WORDS) -> dict[str, pa.Array]:
    import zstandard

    compressor = zstandard.ZstdCompressor(level=LEVEL)
    out: dict[str, list] = {part.split()[0]: [] for part in SCHEMA.split(", ")}
    for text in texts:
        words = text.split()
        n = len(words)
        repeats = repeated_words(words)
        failed = n < min_words or 100 * repeats > 30 * n
        whole = len(compressor.compress(text)) if text else 0
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        sizes = [len(compressor.compress(c)) for c in chunks] if len(chunks) > 1 else [whole] * len(chunks)
        bad = [len(c) for c, size in zip(chunks, sizes) if not _inside(len(c), size)]
        good = bool(text) and _inside(len(text), whole) and sum(bad) <= CHUNK_SHARE * len(text)
        symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
        row = (n, _code_points(b"".join(words)), symbols, repeated_lines(text), repeats, failed, whole / len(text) if text else None, len(chunks), len(bad), not failed and good)
        for name, value in zip(out, row):
            out[name].append(value)
    kinds = {"ratio": pa.float64(), "base_failed": pa.bool_(), "kept": pa.bool_()}
    return {name: pa.array(values, kinds.get(name, pa.int64())) for name, values in out.items()}


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), min_words: int = MIN_WORDS) -> DataFrame:
    """The carried columns, the counts, the ratios and the verdict `kept` of every document. One pass, no shuffle."""
    return map_texts(docs, list(carry), SCHEMA, lambda texts: _measure(texts, min_words))


def keep_good(docs: DataFrame, columns: tuple[str, ...], min_words: int = MIN_WORDS) -> DataFrame:
    """`columns` of the documents that pass all rules."""
    return judge(docs, columns, min_words).filter("kept").select(*columns)
