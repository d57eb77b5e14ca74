"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and rereads it as the documents of the next stage. SQL cannot express
the trained, sampled and greedy stages, so there is no SQL for the rows of ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailsift.llm import exact_dedup, langid, mixing, ngram_join, packing
from mailsift.llm.common import small_batches, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Executors keep what the largest batches took, off their heap and in their Python workers, through all stages.
BATCH_BYTES = 1 << 20


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without letters and unclear ones go."""
    small_batches(spark, BATCH_BYTES)
    return langid.drop_unidentified(docs.select(*COLUMNS))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    small_batches(spark, BATCH_BYTES)
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    small_batches(spark, BATCH_BYTES)
    return ngram_join.keep_one_of_each(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix of sources takes."""
    small_batches(spark, BATCH_BYTES)
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of at most 2,048 words: ``bin_id doc_ids n_words text``."""
    small_batches(spark, BATCH_BYTES)
    return packing.pack_texts(docs)


STAGES = [
    ("language", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
