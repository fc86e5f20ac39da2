"""A corpus from ``documents``: clean by quality rules, keep one of each group of near copies, mix the
sources to their weights, pack into sequences.

Every stage takes all that the one before kept, as rows of ``documents``; the last returns the pieces
with their places. The whole is not expressible in SQL (token ids, similarity components), so tests
compare each stage with a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, ngram_join, packing, quality
from tessera.llm.storage import store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail or lose too much go."""
    return quality.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the n-gram Jaccard join stays."""
    return ngram_join.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequences and offsets."""
    return packing.pack_documents(docs, memory=400_000)  # workers still hold what earlier stages took


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", near_copies), ("source_mixing", source_mix), ("best_fit_packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
