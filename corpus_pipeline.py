"""From documents to packed sequences: quality rules, near-duplicate removal, secret removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``docs`` is what the stage before has written. All but
the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuework.llm import jaccard_join, mixing, packing, quality_rules, secrets
from cuework.llm.scratch import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by doc_id, of each group of near duplicates (five words, similarity 0.8)."""
    return jaccard_join.keep_one(docs, shingle=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.hide(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.curriculum(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids."""
    from public_tokenizers import path

    return packing.pack(docs, path("word_bpe_49k.json"))


STAGES = [("quality_rules", keep_good), ("jaccard_join", keep_distinct), ("secret_scans", hide_secrets),
          ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

ORACLE_SQL = None  # the learned ratios, hashes and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
