"""A corpus from raw documents to packed sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import exact_dedup, packing, quality, simhash, toxicity
from strandlake.shared import scratch, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


# Each stage decides on rows: ids may repeat or be null, columns may have any names, and an empty table stays one.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the cut; an empty or null text stays. Equal texts go or stay together."""
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the importance resample; without labels all. An empty or null text has a weight of zero, as it has no n-grams."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: the one with the largest id (a null id is the smallest), of equal ids the last; null texts are empty ones."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one row: the one with the smallest id, null ids last, of equal ids the first. Texts without words are one group."""
    return simhash.without_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of at most 2048 tokens, a row a piece; an empty or null text is its end token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("packing", pack)]

#: Models, fingerprints and packing have no SQL form; tests/llm/test_pipeline.py has the same in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), scratch(spark, "pipeline"))
    return STAGES[-1][1](spark, docs, sf_dir)
