"""Inputs of the registered queries: the given tables, some with faults injected by a fixed rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; zone-less timestamps become timestamps of the session zone (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stamps = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(stamps) if stamps else df


def blank(column: str, when: Column) -> Column:
    """The column with nulls where the condition holds."""
    return F.when(~when, F.col(column)).alias(column)


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lineitem with missing quantities and flags, and repeated rows."""
    df = load(spark, sf_dir, "lineitem").withColumns({
        "l_quantity": blank("l_quantity", F.col("l_orderkey") % 13 == 0),
        "l_returnflag": blank("l_returnflag", F.col("l_partkey") % 17 == 0),
    })
    return df.unionByName(df.where(F.col("l_orderkey") % 20 == 0))


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole events without the row id, with missing values and types, and repeated rows."""
    df = load(spark, sf_dir, "events").withColumns({
        "value": blank("value", F.col("event_id") % 11 == 0),
        "event_type": blank("event_type", F.col("event_id") % 19 == 0),
        "hour": F.hour("ts"),
    })
    df = df.unionByName(df.where(F.col("event_id") % 25 == 0))
    return df.select("hour", "user_id", "event_type", "value", "ts")


def repeated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole orders plus a second copy of every twentieth order."""
    df = load(spark, sf_dir, "orders")
    return df.unionByName(df.where(F.col("o_orderkey") % 20 == 0))


def priced_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lineitem with derived prices, which correlate strongly."""
    price = F.col("l_extendedprice")
    return load(spark, sf_dir, "lineitem").withColumns({
        "net": price * (1 - F.col("l_discount")), "gross": price * (1 + F.col("l_tax")), "twice": price * 2,
    })


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to their documents' attributes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return load(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic")
