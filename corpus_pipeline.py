"""Documents to packed training sequences: quality rules, near-duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import minhash, packing, quality, secrets
from sievewright.llm.queries import tokenizer_path
from sievewright.storage import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    Null and empty texts go; rows without an id are judged like others, repeated rows alike, very long texts in whole.
    """
    return quality.keep_quality(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id.

    Rows that repeat an id with another text are documents of their own; of rows that repeat id and text one stays.
    Rows without an id count behind all others of their group. Null and empty texts are no copies and stay.
    """
    return minhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked, n_chars following. Null and empty texts stay as they are."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, and their places in sequences of 2048 tokens.

    Null and empty texts are one piece of the end id alone; repeated rows are pieces of their own; null ids stay null;
    very long texts are cut into full sequences and a rest.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("minhash", dedup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: Tokens and compressed sizes are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
