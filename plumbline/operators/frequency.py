"""Value frequencies: top values, mode, class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.operators.columns import BOOLEAN, DATETIME, ColumnInfo, columns_of, slice_key
from plumbline.operators.facts import _families, value_counts
from plumbline.session import small_table


def _text(c: ColumnInfo) -> Column:
    """Display text of a value, computed from its family value."""
    v = F.col("v")
    if c.kind == BOOLEAN:
        return F.when(v == 1, "true").otherwise("false")
    if c.kind == DATETIME:
        return F.date_format(F.timestamp_micros(v), "yyyy-MM-dd HH:mm:ss")
    return v.cast("string")


def value_frequencies(df: DataFrame, cols: Sequence[ColumnInfo] | None = None, by: str | None = None) -> DataFrame:
    """(slice?, ordinal, column, value, n): every distinct present value and its rows."""
    cols = list(cols) if cols is not None else [c for c in columns_of(df, by) if c.kind != "unsupported"]
    keys = ["slice"] if by else []
    parts = []
    for part, members in zip(value_counts(df, cols, by), _families(cols)):
        text, name = F.lit(None).cast("string"), F.lit(None).cast("string")
        for c in members:
            mine = F.col("ordinal") == c.ordinal
            text = F.when(mine, _text(c)).otherwise(text)
            name = F.when(mine, F.lit(c.name)).otherwise(name)
        parts.append(part.select(*keys, "ordinal", name.alias("column"), text.alias("value"), "n"))
    if not parts:
        return small_table(df.sparkSession, [], "ordinal int, column string, value string, n bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def categorical(df: DataFrame, by: str | None = None) -> list[ColumnInfo]:
    return [c for c in columns_of(df, by) if c.kind in ("text", "boolean")]


def ranked_values(freq: DataFrame, top: int) -> DataFrame:
    """The ``top`` most frequent values of each column; ties in ascending text order.

    The rank filter is pushed below the shuffle, so each task hands on at most
    ``top`` rows per column.
    """
    keys = [k for k in ("slice", "ordinal") if k in freq.columns]
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("value"))
    return freq.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= top)


def top_values(
    df: DataFrame, cols: Sequence[ColumnInfo] | None = None, by: str | None = None, top: int = vocab.TOP_VALUES
) -> DataFrame:
    """Frequency table of categorical columns: the top values, the distinct count, whether it was cut."""
    if cols is None:
        cols = categorical(df, by)
    keys = ["slice"] if by else []
    freq = value_frequencies(df, cols, by)
    sizes = freq.groupBy(*keys, "ordinal").agg(F.count(F.lit(1)).alias("nunique"))
    out = ranked_values(freq, top).join(sizes, [*keys, "ordinal"])
    return out.select(*keys, "column", "value", "n", "rk", "nunique", (F.col("nunique") > top).alias("truncated"))


def frequency_tables(df: DataFrame, cols: Sequence[ColumnInfo] | None = None, top: int = vocab.TOP_VALUES) -> DataFrame:
    """One row per categorical column with its top values as a map."""
    entries = F.array_sort(F.collect_list(F.struct("rk", "value", "n")))
    return (
        top_values(df, cols, top=top)
        .groupBy("column", "nunique", "truncated")
        .agg(entries.alias("e"))
        .select("column", "nunique", "truncated", F.map_from_entries(
            F.transform("e", lambda e: F.struct(e["value"], e["n"]))).alias("frequency_table"))
    )


def typed_modes(df: DataFrame, cols: Sequence[ColumnInfo]) -> dict[str, object]:
    """Most frequent value per column, smallest on ties; one driver row per column.

    Grouped counts combine on the map side and the rank filter runs before the
    last shuffle, so a column of unique values costs no more than its count.
    """
    modes: dict[str, object] = {}
    by_ordinal = {c.ordinal: c.name for c in cols}
    for part in value_counts(df, cols):
        order = Window.partitionBy("ordinal").orderBy(F.desc("n"), F.asc("v"))
        best = part.withColumn("rk", F.row_number().over(order)).where("rk = 1")
        for row in best.collect():
            modes[by_ordinal[row["ordinal"]]] = row["v"]
    return modes


def mode_values(df: DataFrame, cols: Sequence[ColumnInfo] | None = None, by: str | None = None) -> DataFrame:
    """Most frequent value per column as text, smallest value on ties."""
    cols = list(cols) if cols is not None else [c for c in columns_of(df, by) if c.kind != "unsupported"]
    keys = ["slice"] if by else []
    parts = []
    for part, members in zip(value_counts(df, cols, by), _families(cols)):
        order = Window.partitionBy(*keys, "ordinal").orderBy(F.desc("n"), F.asc("v"))
        best = part.withColumn("rk", F.row_number().over(order)).where("rk = 1")
        text, name = F.lit(None).cast("string"), F.lit(None).cast("string")
        for c in members:
            mine = F.col("ordinal") == c.ordinal
            text = F.when(mine, _text(c)).otherwise(text)
            name = F.when(mine, F.lit(c.name)).otherwise(name)
        parts.append(best.select(*keys, name.alias("column"), text.alias("value"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def class_balance(df: DataFrame, targets: Sequence[str], by: str | None = None) -> DataFrame:
    """Per target column: classes, smallest and largest class, their ratio and the minority's share."""
    cols = [c for c in columns_of(df, by) if c.name in set(targets)]
    keys = ["slice"] if by else []
    return (
        value_frequencies(df, cols, by)
        .groupBy(*keys, "column")
        .agg(
            F.count(F.lit(1)).alias("classes"), F.min("n").alias("minority"), F.max("n").alias("majority"),
            F.sum("n").alias("total"),
        )
        .withColumn("ratio", F.round(F.col("minority") / F.col("majority"), 4))
        .withColumn("minority_share", F.round(F.col("minority") / F.col("total"), 4))
    )
