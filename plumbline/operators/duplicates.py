"""Exact duplicate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.columns import columns_of, ref, slice_key


def _groupable(c) -> Column:
    """Value usable as a grouping key; null stays null."""
    if isinstance(c.dtype, T.MapType):
        return F.array_sort(F.map_entries(ref(c.name)))
    return c.value


def _fingerprint(df: DataFrame) -> Column:
    """64-bit hash of a row; the null pattern takes part because a hash skips nulls."""
    cols = columns_of(df)
    nulls = F.concat(*[F.when(_groupable(c).isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(nulls, *[_groupable(c) for c in cols])


def duplicate_rows(df: DataFrame, by: str | None = None) -> DataFrame:
    """Rows after the first of each set of equal rows, and the number of distinct rows.

    A first pass shuffles one hash per row, combined on the map side. Only rows
    whose hash occurs again are compared in full, so unique rows never travel
    whole. A row repeated very often arrives as one count per task.
    """
    keys = ["slice"] if by else []
    slices = slice_key(by)
    per_hash = (
        df.select(*slices, _fingerprint(df).alias("h"))
        .groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    totals = per_hash.groupBy(*keys).agg(F.coalesce(F.sum("n"), zero).alias("rows")).withColumn("duplicates", zero)
    again = per_hash.where("n > 1").select(*keys, "h")
    cols = columns_of(df)
    full = df.select(*slices, _fingerprint(df).alias("h"), *[_groupable(c).alias(f"c{c.ordinal}") for c in cols])
    repeated = (
        full.join(again, [*keys, "h"], "left_semi")
        .groupBy(*keys, *[f"c{c.ordinal}" for c in cols])
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicates"))
        .withColumn("rows", zero)
    )
    both = totals.unionByName(repeated).groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("duplicates").alias("duplicates"))
    return both.withColumn("distinct_rows", F.col("rows") - F.col("duplicates"))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows (null equals null; maps are compared by their entries)."""
    cols = columns_of(df)
    if not any(isinstance(c.dtype, T.MapType) for c in cols):
        return df.dropDuplicates()
    keys = [_groupable(c).alias(f"k{c.ordinal}") for c in cols]
    rows = df.groupBy(*keys).agg(*[F.first(ref(c.name)).alias(f"v{c.ordinal}") for c in cols])
    return rows.select(*[F.col(f"v{c.ordinal}").alias(c.name) for c in cols])


def dedupe_counts(df: DataFrame) -> DataFrame:
    """Before/after counts of de-duplication: removed + remaining = original duplicates."""
    before = duplicate_rows(df).withColumn("stage", F.lit("before"))
    after = duplicate_rows(drop_duplicate_rows(df)).withColumn("stage", F.lit("after"))

    def pick(stage: str, column: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(column))).alias(f"{column}_{stage}")

    return before.unionByName(after).agg(
        pick("before", "rows"), pick("before", "duplicates"), pick("after", "rows"), pick("after", "duplicates"),
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))
