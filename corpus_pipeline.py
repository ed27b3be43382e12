"""Corpus pipeline: quality rules, near-duplicate removal, redaction, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import mixing, packing, pii, quality, simhash
from presswork.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy ``strict-1``."""
    return quality.filter_quality(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies."""
    return simhash.keep_one(docs)


def pii_boosting(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data redacted; ``n_chars`` is counted anew."""
    return pii.redacted(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def poisson_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh alike, shuffled."""
    return mixing.replicate(docs).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces with their ids and their places in sequences of 1024 ids; packed in the order of the mixture."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("PII", pii_boosting),
    ("mixing", poisson_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL expresses none of: XXH64 fingerprints, boosted trees, tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
