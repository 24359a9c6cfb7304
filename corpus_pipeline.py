"""A corpus pipeline of five of the corpus operators: language, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. ``run``
writes each stage's rows as Parquet into the shared folder and starts the next stage from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm import language, packing, quality, simhash, suffix_dedup
from tapeworks.llm.queries import tokenizer_file
from tapeworks.llm.shared import materialize

#: The stages go beyond SQL: they are tested against brute-force versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language is undetermined or has a score under one half."""
    return language.keep_identified(docs, language.train(docs), 0.5)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rules or the list learned from ``labels``."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that shares 0.8 of its five-word shingles: that of the smallest id."""
    return simhash.keep_one_of_similar(docs, shingle=5, similarity=0.8)


def strip_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes go that a string of 200 bytes covers which starts anywhere else too; documents stay."""
    return suffix_dedup.strip_repeats(docs, 200)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2,048 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), 2048, 1)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", strip_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = materialize(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
