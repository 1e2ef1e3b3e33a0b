"""The corpus pipeline: toxic documents go, then exact copies, near copies and test items; what stays is packed.

Each stage takes (spark, docs, sf_dir) and calls one operator on everything the
stage before it kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from eventloom.llm.common import table, written
from eventloom.session import configure


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity chain, fitted on the labelled ones, does not reject."""
    return toxicity.drop_toxic(docs, table(configure(spark), sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    configure(spark)
    return exact_dedup.drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at similarity 0.8 on five-word shingles, the smallest doc_id."""
    configure(spark)
    return near_dedup.drop_near(docs, k=5, threshold=80)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate.drop_leaks(docs, table(configure(spark), sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, packed into sequences of 2048 tokens."""
    configure(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", test_items),
    ("packing", packed),
]

# Classification, tokenising and packing are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read back."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
