"""The corpus pipeline: its stages run one after another over documents.

Documents that the quality classifier rejects go; of near-duplicates one document stays;
documents that hold a benchmark item go; sources are mixed to their targets (a document
taken twice is two rows); the rest is written as token files, whose contents are the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelvane.llm import decontaminate, mixing, quality, simhash, token_files
from kelvane.llm.common import STORED, new_path, remove_stored, stored


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files say of each document, in file order."""
    return token_files.read_tokens(token_files.write_tokens(docs, new_path(spark, "tokens")))


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]

#: A fitted model, fingerprints' components and a tokenizer aren't SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the stage before kept, each written as Parquet and read again; then what the stage and the one before it left in the shared folder goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = list(STORED)  # not this run's to remove
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        remove_stored(spark, keep=[*others, STORED[-1]])
    return docs
