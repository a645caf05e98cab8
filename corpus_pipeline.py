"""The corpus pipeline: quality rules, near duplicates, secrets, packing; each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import packing, quality_rules, secret_scans, shingle_join
from lexiloom.llm.common import new_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or the posterior rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8 or more."""
    return shingle_join.keep_one(docs, words=5, num=80, den=100)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, n_chars follows; no document goes."""
    return secret_scans.mask_secrets(docs, count_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and places."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("secret scans", secrets_stage), ("best-fit packing", packing_stage)]

#: Expectation-maximisation, unwrapping and tokenizing have no SQL; tests/llm hold each stage and the whole against plain versions on the smallest table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
