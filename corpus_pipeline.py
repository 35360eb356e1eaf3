"""Pretraining corpus in four stages: quality, near-duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import decontaminate, packing, quality, simhash
from quayside.llm.common import checkpoint, table
from quayside.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, placed in sequences of 2,048 tokens."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``, each cut off from the plan before it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs


#: Trained scores, 64-bit hashes and a tokenizer have no SQL form.
ORACLE_SQL = None
