"""A corpus pipeline over ``documents``: each stage applies one training-data operator to all that its predecessor kept.

Stages are written as Parquet to the shared folder and read again, so each
starts from data that outlives executors.

Defined results, for every stage: a null text is empty (quality rules drop it); a
null language, source or doc_id is a value of its own; very long texts are taken
whole; repeated rows are rows of their own, of which exact dedup keeps the longest,
then that of the smallest doc_id, and near-dedup the one of the smallest doc_id;
rows that repeat a doc_id stay together in the mix's order; extra columns come
through unchanged, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, exact_dedup, mixing, near, quality
from gridloom.llm.common import materialize, table
from gridloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go."""
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more) stays."""
    return near.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shard after shard, each in its shuffled order.

    Ranges of (shard, order) deal a shard over several tasks; rows that repeat
    a doc_id share their order and are told apart by their texts.
    """
    order = ["__shard", "__order", F.xxhash64("text")]
    return mixing.mixed(docs).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of the ids and of the bytes they decode to."""
    return bpe.encode(docs, vocabulary()).drop("offsets")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_tokens),
]
#: Fingerprints, random draws and merges are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
