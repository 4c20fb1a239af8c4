"""Corpus pipeline: five operators in sequence over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limnos.llm import line_dedup, ngram_join, packing, pii, quality
from limnos.llm.common import documents, labels, ship, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    return quality.keep_good(docs, quality.trusted_ids(labels(spark, sf_dir)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of every group of similar lines stays; documents left without
    a word go."""
    ship(spark)
    return line_dedup.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group stays."""
    ship(spark)
    return ngram_join.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    ship(spark)
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the training run: one row per piece of a document."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

# The hashed models and MinHash signatures of the stages have no SQL form; the
# pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
