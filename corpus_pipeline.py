"""The training-corpus pipeline over ``documents``: language ID, quality rules,
near-duplicate removal and packing, one written table per stage.

Defined cases follow the operators'; every stage but the last returns the
columns it was given, so extra columns of ``documents`` pass through."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import langid, minhash, packing, quality
from quarry.session import checkpoint_dir
from quarry.sources.tables import load


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (operator 10)."""
    return langid.identified(docs, langid.fit(docs.where(~langid.held_out())))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 1)."""
    return quality.good_documents(docs, load(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 2)."""
    return minhash.without_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces placed in sequences (operator 5)."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("quality rules", good),
          ("MinHash near-dedup", distinct), ("best-fit packing", packed)]

# Learned weights, boosted trees and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written to the shared
    checkpoint folder and read back as the next one's input."""
    base = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
