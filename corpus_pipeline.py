"""A corpus pipeline of five stages: quality, exact copies, near copies, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eoframe.llm import exact_dedup, mixing, near_copies, packing, quality
from eoframe.llm.queries import tokenizer_file
from eoframe.llm.tables import documents, materialize, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality classifier (fitted on the labels) accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.keep_distinct(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are 0.8 alike or more, over links, the one with the smallest id. Pairs are
    proposed at anchors of SimHash fingerprints, and beyond two bits by bands, and all are checked exactly."""
    return near_copies.keep_one_each(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's share of the mix takes it."""
    return mixing.mixed_documents(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", unlike_documents),
    ("mixing", mixed_documents),
    ("packing", packed_documents),
]
#: A trained classifier and SimHash are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
