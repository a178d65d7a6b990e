"""A corpus pipeline from the operators of plumbline.llm: rules, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and its result is written as Parquet
and read again as the docs of the next. All but the last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import debruijn, order_minhash, quality_rules, sentencepiece_bpe, string_tiling
from plumbline.llm.queries import table, tokenizer_path
from plumbline.session import shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return order_minhash.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur again anywhere are cut from the texts."""
    return debruijn.cut(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return string_tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining text, as count and digests, with the digest of the decoded text."""
    return sentencepiece_bpe.encoded(docs, sentencepiece_bpe.Vocabulary.load(tokenizer_path()))


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one),
    ("repeated_passages", cut_passages),
    ("benchmark_leaks", drop_leaks),
    ("sentencepiece", encode),
]

#: SQL cannot express the sketches, the tiling and the tokenizer; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{at}-{name}")
        docs = spark.read.parquet(f"{where}/{at}-{name}")
    return docs
