"""From raw documents to packed training sequences, in five stages.

Each stage gets the documents that the one before it kept, written and read again, and works on all of them. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, near_copies, packing, quality_classifier, quality_rules
from quern.llm.queries import TARGET_ENTROPY, TOKENIZER, table
from quern.llm.text import DOCUMENT_COLUMNS
from quern.plans.columns import pick
from quern.plans.lineage import fresh_dir


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go; a text is not poor for being short, so any with a word may stay."""
    return quality_rules.keep_good(docs, DOCUMENT_COLUMNS, min_words=1)


def apply_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, scores below its threshold go.

    All stay where nothing could be learned, since then every score is the same.
    """
    weights = quality_classifier.train(docs, table(spark, sf_dir, "labels"), ~quality_classifier.is_held_out())
    if not weights.any():
        return pick(docs, *DOCUMENT_COLUMNS)
    return quality_classifier.score(docs, weights, DOCUMENT_COLUMNS).filter("predicted = 1").select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of the five-word runs in common, or more) stays."""
    return near_copies.keep_one(docs, DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over each document; the budget passes over every source once at least, so none is lost."""
    return mixing.mix(docs, target_entropy=TARGET_ENTROPY, carry=("text", "lang", "n_chars")).select(*DOCUMENT_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 4096 tokens."""
    return packing.pack(packing.token_pieces(docs, TOKENIZER, digest_only=True))


STAGES = [
    ("quality rules", apply_rules),
    ("quality classifier", apply_classifier),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Compression ratios, fingerprints and token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; what each keeps is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        folder = fresh_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
