"""Registered queries of the subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    alignment, archives, byte_bpe, context_mixing, debruijn, importance, licences, order_minhash, quality_rules, sentencepiece_bpe,
    string_tiling, unigram_counts, url_rules,
)
from plumbline.llm.sql import SQL  # noqa: F401
from plumbline.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The host and path rules of the URL filter.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public tokenizer's file; it is read on the driver and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_url_rules(spark, sf):
    pages = table(spark, sf, "pages")
    mined = url_rules.mine(url_rules.labelled_urls(pages, table(spark, sf, "labels")))
    return url_rules.judge(pages, URL_RULES, mined)


@query
def op2_order_minhash(spark, sf):
    return order_minhash.classes(table(spark, sf, "documents")).select("doc_id", "class_id")


@query
def op5_sentencepiece(spark, sf):
    vocabulary = sentencepiece_bpe.Vocabulary.load(tokenizer_path())
    return sentencepiece_bpe.encoded(table(spark, sf, "documents"), vocabulary)


@query
def op7_repetition(spark, sf):
    return quality_rules.repetition(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_token_counts(spark, sf):
    vocabulary = unigram_counts.Unigram.from_sentencepiece(tokenizer_path())
    return unigram_counts.token_counts(table(spark, sf, "documents"), vocabulary)


@query
def op10_licences(spark, sf):
    return licences.scan(table(spark, sf, "documents")).withColumn("score", F.round("score", 9))


@query
def op3_string_tiling(spark, sf):
    return string_tiling.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op6_archives(spark, sf):
    where = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    archives.write_arc(table(spark, sf, "pages"), f"{where}/arc")
    archives.convert(spark, f"{where}/arc", f"{where}/warc")
    return archives.warc_pages(spark, f"{where}/warc")


@query
def op8_debruijn(spark, sf):
    return debruijn.removal(table(spark, sf, "documents"))


@query
def op4_context_mixing(spark, sf):
    return context_mixing.scores(table(spark, sf, "documents"))


@query
def op11_byte_bpe(spark, sf):
    import public_tokenizers

    vocabulary = byte_bpe.Vocabulary.load(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.encoded(table(spark, sf, "documents"), vocabulary)


@query
def op12_importance(spark, sf):
    drawn = importance.draw(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_alignment(spark, sf):
    import public_tokenizers

    tokenizers = alignment.Tokenizers.load(
        tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, tokenizer_path())
    return alignment.alignment(table(spark, sf, "documents"), tokenizers)
