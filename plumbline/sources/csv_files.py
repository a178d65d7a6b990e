"""Reading messy CSV files: encoding, banner line, missing header, missing tokens, column types.

The repairs are decided on the field counts of all records of all files; the data itself is read by the distributed CSV
reader, or cut into records in parallel where cells go on over line breaks, as text, and typed from one aggregate.
"""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vocab
from plumbline.operators.columns import ref
from plumbline.sources import csv_records
from plumbline.session import small_table

_EXTRA = "_extra"


class ScanError(Exception):
    """A file that cannot be read as a table, with the reason."""


@dataclass(frozen=True)
class Layout:
    """How to read a file: encoding, lines before the data, column names."""

    encoding: str
    banner: str | None
    header_line: str | None
    names: tuple[str, ...]


def _unique(names: Sequence[str]) -> tuple[str, ...]:
    """Column names without blanks or repeats: a, a.1, a.2."""
    seen: Counter[str] = Counter()
    taken, out = set(), []
    for i, raw in enumerate(names):
        base = raw if raw != "" else f"Unnamed: {i}"
        name = base
        while name in taken:
            seen[base] += 1
            name = f"{base}.{seen[base]}"
        taken.add(name)
        out.append(name)
    return tuple(out)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is valid UTF-8, else Latin-1."""
    return "UTF-8" if csv_records.line_facts(spark, path)[1] else "ISO-8859-1"


def has_broken_cells(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell may go on over a line break: some line has an odd number of quotes."""
    return csv_records.line_facts(spark, path)[2]


def _decoded(record: Column, encoding: str) -> Column:
    return record.cast("string") if encoding == "UTF-8" else F.decode(record, encoding)


def _cells_are_numbers(line: Column) -> Column:
    """Whether every cell of a line reads as a number."""
    def number(cell: Column) -> Column:
        bare = F.lower(F.trim(F.regexp_replace(cell, '^"|"$', "")))
        return bare.try_cast("double").isNotNull() & ~bare.rlike("[df]$")

    return F.forall(F.split(line, ","), number)


def scan_records(spark: SparkSession, path: str, encoding: str | None = None, multiline: bool | None = None) -> tuple[str, DataFrame, bool]:
    """(encoding, records, whether cells go on over line breaks) of CSV files."""
    try:
        some, utf8, odd = csv_records.line_facts(spark, path)
    except AnalysisException as error:
        raise ScanError(f"File not found: {path}") from error
    if not some:
        raise ScanError(f"CSV file is empty: {path}")
    broken = odd if multiline is None else multiline
    rows = csv_records.records(spark, path) if broken else csv_records.line_records(spark, path)
    return encoding or ("UTF-8" if utf8 else "ISO-8859-1"), rows, broken


def decide_layout(path: str, encoding: str, rows: DataFrame) -> Layout:
    """Banner, header and names from the field counts of all records of all files; files that disagree raise."""
    files = csv_records.file_layouts(rows).withColumn("banner", csv_records.is_banner()).withColumn(
        "header", _decoded(F.when(F.col("banner"), F.col("second")).otherwise(F.col("first")), encoding))
    files = files.withColumn("bare", _cells_are_numbers(F.col("header"))).withColumn(
        "header_fields", F.when(F.col("banner"), F.col("second_fields")).otherwise(F.col("first_fields")))
    bad = csv_records.narrow_first() & ~F.col("banner")
    kinds = files.groupBy("banner", "bare", F.when(~F.col("bare"), F.col("header")).alias("header_line"), "header_fields").agg(
        F.min("file").alias("file"), F.max(F.when(bad, F.struct("first_fields", "width", "file"))).alias("bad"),
        F.max_by("width", "at_width").alias("width"), F.min("header").alias("header"),
        F.min(_decoded(F.col("first"), encoding)).alias("banner_line"), F.max("at_width").alias("most"),
    ).orderBy(F.desc("most"), "file").limit(2).collect()
    if not kinds:
        raise ScanError(f"CSV file has no columns to parse: {path}")
    for kind in kinds:
        if kind["bad"] is not None:
            raise ScanError(
                f"{kind['bad']['file']} looks malformed: the header implies {kind['bad']['first_fields']} column(s), but data rows "
                f"consistently have {kind['bad']['width']} comma-separated fields. Remove any non-data lines before the header.")
    if len(kinds) > 1:
        raise ScanError(f"{kinds[0]['file']} and {kinds[1]['file']} do not have the same head lines.")
    kind = kinds[0]
    header = next(csv.reader([kind["header"]]))
    banner = kind["banner_line"] if kind["banner"] else None
    if kind["bare"]:
        return Layout(encoding, banner, None, tuple(f"column_{i}" for i in range(len(header))))
    # Rows wider than the header carry unnamed leading index fields.
    spare = max(kind["width"] - len(header), 0)
    index = [f"_index_{i}" if i else "_index" for i in range(spare)]
    return Layout(encoding, banner, kind["header"], _unique([*index, *header]))


def detect_layout(spark: SparkSession, path: str, encoding: str | None = None) -> Layout:
    """How to read the files, from all their records."""
    encoding, rows, _ = scan_records(spark, path, encoding)
    return decide_layout(path, encoding, rows)


def _text_rows(spark: SparkSession, path: str, layout: Layout, rows: DataFrame, broken: bool) -> DataFrame:
    """All cells as text, one column per name and one for fields beyond the width."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*layout.names, _EXTRA)])
    options = {"escape": '"', "mode": "PERMISSIVE"}
    if layout.banner is None and not broken:
        return spark.read.csv(
            path, schema=schema, header=layout.header_line is not None, encoding=layout.encoding, enforceSchema=True, **options)
    rows = rows.where(csv_records.present(F.col("record"))).select(
        "file", "start", "place", _decoded(F.col("record"), layout.encoding).alias("line"))
    # the first banner and header line of each file go, by their place; equal lines further down are data
    heads = [rows] if layout.banner is not None else []
    heads += [rows.where(F.col("line") == layout.header_line)] if layout.header_line is not None else []
    for head in heads:
        rows = rows.join(csv_records.sent(csv_records.first_places(head)), ["file", "start", "place"], "left_anti")
    return rows.select(F.from_csv("line", F.lit(schema.toDDL()), options).alias("r")).select("r.*")


def present(c: Column) -> Column:
    """Cell text, or null when it is one of the missing tokens (no trimming)."""
    return F.when(~c.isin(*vocab.MISSING_TOKENS), c)


def _as_double(c: Column) -> Column:
    """Number text as double; a Java type suffix (1d, 1f) is not a number."""
    lettered = c.contains("d") | c.contains("D") | c.contains("f") | c.contains("F")
    suffixed = lettered & c.rlike(r"\d\.?[dDfF]\s*$")
    return F.when(~suffixed, c.try_cast("double"))


def _as_bigint(c: Column) -> Column:
    """Whole number text as bigint; a text with a dot is none, and a cast that fails is slow."""
    return F.when(~c.contains("."), c.try_cast("bigint"))


def infer_types(rows: DataFrame, names: Sequence[str]) -> tuple[dict[str, str], int, int]:
    """Column types, row count and rows with surplus fields, from aggregates over the text cells."""
    # one row per cell, so that the generated code stays small whatever the number of columns
    cells = rows.select(F.posexplode(F.array(*[ref(n) for n in (*names, _EXTRA)])).alias("at", "text"))
    c = F.col("cell")
    counted = cells.select("at", "text", present(F.col("text")).alias("cell")).groupBy("at").agg(
        F.count(F.lit(1)).alias("rows"), F.count("text").alias("filled"), F.count(c).alias("n"),
        F.count(_as_bigint(c)).alias("l"), F.count(_as_double(c)).alias("d"),
        F.count(F.when(c.isin(*vocab.TRUE_WORDS, *vocab.FALSE_WORDS), 1)).alias("b")).collect()
    by_place = {row["at"]: row for row in counted}
    types: dict[str, str] = {}
    if not by_place:
        return dict.fromkeys(names, "double"), 0, 0
    total, surplus = by_place[0]["rows"], by_place[len(names)]["filled"]
    for at, name in enumerate(names):
        row = by_place[at]
        if row["n"] == row["d"]:
            types[name] = "bigint" if row["n"] > 0 and row["n"] == row["l"] else "double"
        else:
            types[name] = "boolean" if row["n"] == row["b"] == total else "string"
    return types, total, surplus


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    out = []
    for name, kind in types.items():
        c = present(ref(name))
        value = {
            "bigint": c.try_cast("bigint"), "double": _as_double(c), "string": c,
            "boolean": c.isin(*vocab.TRUE_WORDS),
        }[kind]
        out.append(value.alias(name))
    return rows.select(*out)


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    multiline: bool | None = None,
    max_rows: int | None = None,
    max_columns: int | None = None,
    stage_to: str | None = None,
) -> DataFrame:
    """Read CSV files with repairs and typed columns.

    Line breaks in quoted cells are found by a pass over the lines and cut in parallel (``multiline`` sets by hand whether
    there are any). The layout is decided from all records of all files. ``max_rows`` and ``max_columns`` are optional
    guards that raise; nothing is ever cut off. ``stage_to`` writes the typed
    table there as parquet and returns it, so that later passes read columns
    instead of parsing text again.
    """
    encoding, records, broken = scan_records(spark, path, encoding, multiline)
    layout = decide_layout(path, encoding, records)
    if max_columns and len(layout.names) > max_columns:
        raise ScanError(f"{path} has {len(layout.names):,} columns, above the {max_columns:,}-column limit.")
    rows = _text_rows(spark, path, layout, records, broken)
    types, total, surplus = infer_types(rows, layout.names)
    if surplus:
        raise ScanError(f"CSV file is corrupted or malformed: {path} ({surplus} rows have too many fields)")
    if max_rows and total > max_rows:
        raise ScanError(f"{path} has {total:,} rows, above the {max_rows:,}-row limit.")
    table = typed(rows, types)
    if stage_to is None:
        return table
    table.write.mode("errorifexists").parquet(stage_to)
    return spark.read.parquet(stage_to)


def shape_preview(df: DataFrame) -> DataFrame:
    """One row: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def layout_table(spark: SparkSession, path: str) -> DataFrame:
    """What the scan decided about a file, as one row."""
    layout = detect_layout(spark, path)
    return small_table(
        spark, [(layout.encoding, layout.banner, layout.header_line is not None, list(layout.names))],
        "encoding string, banner string, has_header boolean, names array<string>")
