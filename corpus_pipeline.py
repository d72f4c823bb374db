"""A corpus pipeline over ``documents``: filter, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``, and work on every row they get.  What each
does with nulls, empty texts, repeated rows and empty tables is said by its
operator's module in ``cohortlens/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import common, mixing, packing, quality, simhash, substring


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from ``labels``, accepts."""
    common.prepare(spark)
    return quality.accepted(docs, quality.train(docs, common.read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    common.prepare(spark)
    return simhash.one_per_component(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that a document with a smaller id has."""
    common.prepare(spark)
    return substring.cut_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut to the words that the mix of sources takes, twice-taken words as rows of their own."""
    common.prepare(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their place in sequences of at most 2048 tokens."""
    common.prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("filter_quality", filter_quality),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_repeated_passages", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The classifier, the hashes and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stage's rows written once to the shared folder."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
