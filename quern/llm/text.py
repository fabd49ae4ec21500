"""Shared text rules: the six ASCII white-space bytes separate words, and only A-Z are lower-cased.

Python's `bytes.split()` and `bytes.lower()` follow exactly these rules on UTF-8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.columns import pick

#: A word, in the dialect of both Java and Python regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are objects at a time.
BATCH_BYTES = 16 << 20
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def text_bytes(text: str = "text") -> Column:
    """A text's UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves `remainder`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def bounded(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a binary column holds about `most` bytes in each, or one row; Spark bounds them by rows alone."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows or not batch.num_rows:
            full = (ends[at - 1] if at else 0) + most
            n = max(1, int(np.searchsorted(ends, full, "right")) - at)
            yield batch.slice(at, n)
            at += n
            if not batch.num_rows:
                break


def map_texts(docs: DataFrame, carry: list[str], schema: str, per_text: Callable[[list[bytes]], dict[str, list]]) -> DataFrame:
    """One row out per document: the `carry` columns, then what `per_text` makes of an Arrow batch of texts.

    Texts arrive as UTF-8 bytes (null: empty). A part of a batch, bounded in bytes, is all that a task turns into objects.
    """
    source = pick(docs, *dict.fromkeys([*carry, "text"]))
    source = source.select(*carry, text_bytes().alias("_bytes"))
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    types = dict(source.select(*carry).dtypes) if carry else {}
    out = ", ".join([*(f"`{c}` {types[c]}" for c in carry), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_bytes"):
            made = per_text(batch.column("_bytes").to_pylist())
            kept = [batch.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(made[n]) if not isinstance(made[n], pa.Array) else made[n] for n in names]], names=[*carry, *names])

    return source.mapInArrow(run, out)
