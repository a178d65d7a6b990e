"""Writing cleaned tables and result tables, and reading them back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.columns import ref
from plumbline.operators.duplicates import duplicate_rows


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as a CSV cell holds only text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        (F.to_json(ref(f.name)) if isinstance(f.dataType, nested) else ref(f.name)).alias(f.name)
        for f in df.schema.fields
    ])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a cleaned table as parquet (default) or as CSV with a header and no index."""
    if fmt == "csv":
        _flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def reread(spark: SparkSession, path: str, like: DataFrame, fmt: str = "parquet") -> DataFrame:
    """A written table with the types it was written with."""
    if fmt == "csv":
        return spark.read.schema(_flat(like).schema).option("header", True).option("escape", '"').csv(path)
    return spark.read.format(fmt).load(path)


def round_trip_check(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """One row: do the written rows have the same rows and duplicates as the table?"""
    written = reread(df.sparkSession, path, df, fmt)
    sides = duplicate_rows(df).withColumn("side", F.lit("table")).unionByName(
        duplicate_rows(written).withColumn("side", F.lit("file")))

    def pick(side: str, column: str):
        return F.max(F.when(F.col("side") == side, F.col(column))).alias(f"{column}_{side}")

    row = sides.agg(pick("table", "rows"), pick("file", "rows"), pick("table", "duplicates"), pick("file", "duplicates"))
    return row.withColumn(
        "same", (F.col("rows_table") == F.col("rows_file")) & (F.col("duplicates_table") == F.col("duplicates_file")))


def write_results(tables: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One JSON folder per result table."""
    for name, table in tables.items():
        table.write.mode(mode).json(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(f"{path}/{name}")
