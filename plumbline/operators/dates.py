"""Date detection in text columns, and date ranges.

Values are counted by shape first: digits become 9, letters become a. From the counts follows an exact upper bound of the
share that each format can read, so only formats that can reach the wanted share are ever tried, in their order, and the
first that does reach it ends the search. A value is parsed only with formats whose pattern it fits; no failing parse is
paid for."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.operators.columns import DATETIME, TEXT, ColumnInfo, columns_of
from plumbline.session import small_table

FREE = "free"
#: Characters after trimming that a date may have; longer values share one shape.
LONGEST = 100
_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_FIELDS = {"y": "[+-]?[0-9]{4,}", "M": "0*(?:[1-9]|1[0-2])", "d": "0*(?:[1-9]|[12][0-9]|3[01])", "H": "0*(?:1?[0-9]|2[0-3])",
           "m": "0*[1-5]?[0-9]", "s": "0*[1-5]?[0-9]"}


def value_pattern(fmt: str) -> str:
    """Pattern of all values that a format can read (and perhaps of some that it cannot, such as 2021-02-30)."""
    parts = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z])", fmt)
    return "^" + "".join(re.escape(mark) if mark else "[A-Za-z]+" if letter + more == "MMM" else _FIELDS[letter]
                         for letter, more, mark in parts) + "$"


def shape_pattern(fmt: str) -> str:
    """Pattern of the shapes of all values that a format can read."""
    parts = re.findall(r"(y+)|(MMM)|([MdHms]+)|([^A-Za-z])", fmt)
    return "^" + "".join("[+-]?9{4,}" if y else "a+" if name else "9+" if short else re.escape(mark)
                         for y, name, short, mark in parts) + "$"


def shape(c: Column) -> Column:
    """The value with 9 for each digit and a for each letter; one common shape for values too long to be dates."""
    letters = _LETTERS + _LETTERS.upper()
    masked = F.translate(c, _DIGITS + letters, "9" * len(_DIGITS) + "a" * len(letters))
    return F.when(F.length(F.trim(c)) <= LONGEST, masked).otherwise(F.when(c.isNotNull(), F.lit("(long)")))


def value_shapes(df: DataFrame, cols: Sequence[ColumnInfo] | None = None) -> DataFrame:
    """(ordinal, column, shape, n) of the text columns' values; counted per task before the shuffle."""
    cols = list(cols) if cols is not None else [c for c in columns_of(df) if c.kind == TEXT]
    if not cols:
        return small_table(df.sparkSession, [], "ordinal int, column string, shape string, n bigint")
    cells = F.array(*[F.struct(F.lit(c.ordinal).alias("ordinal"), F.lit(c.name).alias("column"), shape(c.value).alias("shape"))
                      for c in cols])
    return df.select(F.inline(cells)).where("shape is not null").groupBy("ordinal", "column", "shape").agg(
        F.count(F.lit(1)).alias("n"))


def format_bounds(df: DataFrame, cols: Sequence[ColumnInfo] | None = None) -> DataFrame:
    """(ordinal, column, format, most): the largest share of a text column that each format could read, from its shapes."""
    shapes = value_shapes(df, cols)
    sums = [F.sum(F.when(F.col("shape").rlike(shape_pattern(f)), F.col("n")).otherwise(0)).alias(f"m{i}")
            for i, f in enumerate(vocab.DATE_FORMATS)]
    wide = shapes.groupBy("ordinal", "column").agg(F.sum("n").alias("n"), *sums)
    return wide.select("ordinal", "column", F.inline(F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(f).alias("format"), (F.col(f"m{i}") / F.col("n")).alias("most"))
        for i, f in enumerate(vocab.DATE_FORMATS)])))


def parse_date(c: Column, fmt: str) -> Column:
    """Timestamp of a text value; null when it does not match the format."""
    if fmt == FREE:
        return F.coalesce(*[parse_date(c, f) for f in vocab.DATE_FORMATS], c.try_cast("timestamp"))
    return F.when(c.rlike(value_pattern(fmt)), F.try_to_timestamp(c, F.lit(fmt)))


def date_formats(df: DataFrame, cols: Sequence[ColumnInfo] | None = None) -> DataFrame:
    """(column, format) of the text columns that read as dates, judged on all their values.

    One pass applies a cheap pattern gate to every text column and one counts the shapes of those that pass it. Then the
    formats that the shapes allow are tried in order, one pass for the next format of all undecided columns: the first that
    reads at least 90 % is taken, then free parsing.
    """
    cols = list(cols) if cols is not None else [c for c in columns_of(df) if c.kind == TEXT]
    spark, schema = df.sparkSession, "column string, format string"
    if not cols:
        return small_table(spark, [], schema)
    gates = df.agg(*[
        F.avg(F.trim(c.value).rlike(vocab.DATE_LIKE_PATTERN).cast("double")).alias(f"g{c.ordinal}") for c in cols]).first()
    passed = [c for c in cols if (gates[f"g{c.ordinal}"] or 0.0) >= vocab.DATE_GATE_SHARE]
    if not passed:
        return small_table(spark, [], schema)
    able = format_bounds(df, passed).where(F.col("most") >= vocab.DATE_PARSE_SHARE).orderBy("ordinal", "place").collect()
    left = {c: [*[r["format"] for r in able if r["ordinal"] == c.ordinal], FREE] for c in passed}
    chosen: dict[int, tuple[str, str]] = {}
    while left:
        now = {c: formats[0] for c, formats in left.items()}
        shares = df.agg(*[
            F.avg(F.when(c.value.isNotNull(), parse_date(c.value, f).isNotNull().cast("double"))).alias(f"s{c.ordinal}")
            for c, f in now.items()]).first()
        chosen |= {c.ordinal: (c.name, f) for c, f in now.items() if shares[f"s{c.ordinal}"] >= vocab.DATE_PARSE_SHARE}
        left = {c: formats[1:] for c, formats in left.items() if c.ordinal not in chosen and len(formats) > 1}
    return small_table(spark, [chosen[c.ordinal] for c in passed if c.ordinal in chosen], schema)


def datetime_profile(df: DataFrame, cols: Sequence[ColumnInfo] | None = None) -> DataFrame:
    """Date columns (native, or text that reads as dates) with range and distinct calendar parts.

    One scan for all candidate columns. The calendar parts are small sets
    (years, 12 months, 31 days), so they are gathered as sets instead of
    expanding every row per distinct count.
    """
    cols = list(cols) if cols is not None else columns_of(df)
    spark = df.sparkSession
    schema = "ordinal int, column string, format string, min_date string, max_date string, " \
             "distinct_years bigint, distinct_months bigint, distinct_days bigint"
    found = {r["column"]: r["format"] for r in date_formats(df, [c for c in cols if c.kind == TEXT]).collect()}
    picks = [(c, found.get(c.name, "native")) for c in cols if c.kind == DATETIME or c.name in found]
    if not picks:
        return small_table(spark, [], schema)
    stamps = [
        c.value.cast("timestamp") if fmt == "native" else parse_date(c.value, fmt) for c, fmt in picks
    ]
    flat = df.select(*[c.value.isNotNull().alias(f"p{i}") for i, (c, _) in enumerate(picks)],
                     *[s.alias(f"t{i}") for i, s in enumerate(stamps)])
    aggs = []
    for i in range(len(picks)):
        t = F.col(f"t{i}")
        aggs += [
            F.count(F.when(F.col(f"p{i}"), 1)).alias(f"n{i}"), F.count(t).alias(f"k{i}"),
            F.min(t).alias(f"lo{i}"), F.max(t).alias(f"hi{i}"),
            F.collect_set(F.year(t)).alias(f"y{i}"), F.collect_set(F.month(t)).alias(f"m{i}"),
            F.collect_set(F.dayofmonth(t)).alias(f"d{i}"),
        ]
    wide = flat.agg(*aggs)
    packed = [
        F.struct(
            F.lit(c.ordinal).alias("ordinal"), F.lit(c.name).alias("column"), F.lit(fmt).alias("format"),
            F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("parsed"),
            F.date_format(F.col(f"lo{i}"), "yyyy-MM-dd").alias("min_date"),
            F.date_format(F.col(f"hi{i}"), "yyyy-MM-dd").alias("max_date"),
            F.size(f"y{i}").cast("bigint").alias("distinct_years"),
            F.size(f"m{i}").cast("bigint").alias("distinct_months"),
            F.size(f"d{i}").cast("bigint").alias("distinct_days"),
        )
        for i, (c, fmt) in enumerate(picks)
    ]
    return (
        wide.select(F.inline(F.array(*packed)))
        .where((F.col("n") > 0) & (F.col("parsed") / F.col("n") >= vocab.DATE_PARSE_SHARE))
        .drop("n", "parsed")
    )
