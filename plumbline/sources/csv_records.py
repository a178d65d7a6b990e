"""CSV records that go on over line breaks, cut in parallel, and the layout of every file of a folder.

Whether a line break ends a record depends on the quotes of all text before it. A stretch of lines is therefore a function
of one bit, whether it begins inside a quoted cell. Each split of a file computes both results in one pass; they are
composed along the file, one row for each split, which tells every split how it begins. A second pass cuts the records.
Only records that cross the border of a split are put together by a shuffle, and there is at most one for each border.
Files thus stay as many tasks as they have splits. A quote counts only where a cell begins or where one is open, so a stray
quote inside an unquoted cell changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.session import staged

#: Splits up to which their states are sent to all tasks instead of being joined by a shuffle.
SENT_SPLITS = 200_000
#: Bytes of lines that a task holds as Python objects at once, besides the record it is in.
SLICE_BYTES = 2 << 20
COMPLETE, CONTINUES, OPENS = 0, 1, 2

_CLOSE = re.compile(rb'[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,|\Z)')
_FIELD = re.compile(rb'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,"][^,]*+|)(?:,|\Z)')


def fields_of(line: bytes, inside: bool = False) -> tuple[int, bool]:
    """(fields that begin or go on in the line, whether its end is inside a quoted cell)."""
    at, count, rest = 0, 0, _CLOSE if inside else _FIELD
    while True:
        found = rest.match(line, at)
        count += 1
        if found is None:
            return count, True
        at, rest = found.end(), _FIELD
        if at == len(line) and not line.endswith(b",", found.start()):
            return count, False


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, at, line): the bytes of each line without its line feed, in order within each split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Runs of lines of one split."""
    if not batch.num_rows:
        return
    starts, files = batch.column("start"), batch.column("file")
    change = pc.or_(pc.not_equal(starts.slice(1), starts.slice(0, len(starts) - 1)),
                    pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)))
    begins = [0, *(i + 1 for i in pc.indices_nonzero(change).to_pylist()), len(starts)]
    for begin, end in zip(begins, begins[1:]):
        yield (files[begin].as_py(), starts[begin].as_py()), batch.slice(begin, end - begin)


def _slices(values: pa.Array) -> Iterator[list[bytes]]:
    """The values in order, in lists of about SLICE_BYTES."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begins = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(values)]
    for begin, end in zip(begins, begins[1:]):
        yield values.slice(begin, end - begin).to_pylist()


def split_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether each split begins inside a quoted cell."""
    struct = T.StructType.fromDDL("file string, start bigint, from_outside boolean, from_inside boolean")
    schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends = None, [False, True]
        for batch in batches:
            for split, rows in _stretches(batch):
                if split != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, *ends)], schema=schema)
                    now, ends = split, [False, True]
                line = rows.column("line")
                for raws in _slices(line.filter(pc.match_substring(line, '"'))):
                    for raw in raws:
                        ends = [fields_of(raw, inside)[1] for inside in ends]
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, *ends)], schema=schema)

    states = T.StructType.fromDDL("file string, start bigint, inside boolean")
    arrow_states = to_arrow_schema(states)

    def along(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start")
        inside, begins = False, []
        for outside_end, inside_end in zip(rows["from_outside"].to_pylist(), rows["from_inside"].to_pylist()):
            begins.append(inside)
            inside = inside_end if inside else outside_end
        return pa.Table.from_arrays([rows["file"], rows["start"], pa.array(begins, pa.bool_())], schema=arrow_states)

    both = lines.select("file", "start", "line").mapInArrow(run, struct)
    return both.groupBy("file").applyInArrow(along, states)  # one row for each split of a file


def _cut(lines: DataFrame) -> DataFrame:
    """(file, start, place, kind, fields, record) of rows (file, start, line, inside) in order within each split. A record
    that crosses the end of its split is one piece OPENS, then one piece CONTINUES in each split that it reaches."""
    struct = T.StructType.fromDDL("file string, start bigint, place bigint, kind int, fields int, record binary")
    schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, kind, inside, held, size = None, 0, COMPLETE, False, [], 0
        out: list[tuple] = []

        def put(last: int) -> None:
            nonlocal place, kind, held, size
            record = b"\n".join(held)
            if last != OPENS and record.endswith(b"\r"):
                record = record[:-1]
            out.append((*now, place, last, fields_of(record)[0] if last == COMPLETE else None, record))
            place, kind, held, size = place + 1, COMPLETE, [], size + len(record)

        def batch_of() -> pa.RecordBatch:
            nonlocal size
            size = 0
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for split, rows in _stretches(batch):
                if split != now:
                    if held:
                        put(OPENS if kind == COMPLETE else CONTINUES)
                    now, place = split, 0
                    inside = rows.column("inside")[0].as_py()
                    kind = CONTINUES if inside else COMPLETE
                for raws in _slices(rows.column("line")):
                    for raw in raws:
                        held.append(raw)
                        inside = fields_of(raw, inside)[1] if b'"' in raw else inside
                        if not inside:
                            put(kind)
                    if size >= SLICE_BYTES:
                        yield batch_of()
            if out:
                yield batch_of()
        if held:
            put(OPENS if kind == COMPLETE else CONTINUES)
        if out:
            yield batch_of()

    return lines.select("file", "start", "line", "inside").mapInArrow(run, struct)


def _counted(records: DataFrame) -> DataFrame:
    """The records with their number of fields."""
    schema = to_arrow_schema(records.schema)
    at = schema.get_field_index("fields")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = pa.array([fields_of(r)[0] for some in _slices(batch.column("record")) for r in some], pa.int32())
            yield pa.RecordBatch.from_arrays([fields if i == at else c for i, c in enumerate(batch.columns)], schema=schema)

    return records.mapInArrow(run, records.schema)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, place, fields, record): every record of CSV files as bytes, at its place among those of its split.

    Blank lines are records of one field. A file whose last quote never closes ends with that record."""
    lines = raw_lines(spark, path)
    states = staged(split_states(lines))
    few = states.count() <= SENT_SPLITS
    told = lines.join(F.broadcast(states) if few else states, ["file", "start"])
    if not few:
        told = told.repartition("file", "start").sortWithinPartitions("file", "start", "at")
    pieces = staged(_cut(told))
    whole = pieces.where(F.col("kind") == COMPLETE).select("file", "start", "place", "fields", "record")
    # a piece that continues belongs to the last record of its file that opened before it
    before = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = pieces.where(F.col("kind") != COMPLETE).withColumn(
        "opened", F.last(F.when(F.col("kind") == OPENS, F.struct("start", "place")), ignorenulls=True).over(before))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    joined = crossing.groupBy("file", "opened").agg(parts.alias("parts")).select(
        "file", F.col("opened.start").alias("start"), F.col("opened.place").alias("place"), F.lit(None).cast("int").alias("fields"),
        F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1))), F.get("parts", F.lit(0))["record"],
                    lambda text, part: F.concat(text, F.lit(b"\n"), part["record"])).alias("record"))
    return whole.unionByName(_counted(joined))


def line_records(spark: SparkSession, path: str) -> DataFrame:
    """The same columns for files without line breaks in cells: each line is a record; JVM expressions only."""
    text = F.col("line").cast("string")
    bare = F.when(text.contains('"'), F.regexp_replace(text, '"[^"]*"', "")).otherwise(text)
    return raw_lines(spark, path).select(
        "file", "start", F.col("at").alias("place"), (F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1).alias("fields"),
        F.when(F.substring(text, -1, 1) == "\r", F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text).cast("binary").alias("record"))


def line_facts(spark: SparkSession, path: str) -> tuple[bool, bool, bool]:
    """(whether there are lines, whether all are UTF-8, whether a quoted cell goes on over a line break), in one pass."""
    text = F.col("line").cast("string")
    odd = (F.length(text) - F.length(F.replace(text, F.lit('"')))) % 2 == 1
    row = raw_lines(spark, path).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.is_valid_utf8(text)).alias("utf8"), F.bool_or(odd).alias("odd")).first()
    return row["n"] > 0, row["utf8"] is not False, bool(row["odd"])


def present(record: Column) -> Column:
    """Whether a record is more than a blank line."""
    return F.trim(record.cast("string"), F.lit(" \t\r")) != ""


def first_places(rows: DataFrame) -> DataFrame:
    """(file, start, place) of the first of the rows of each file; tasks sum up to one place for each split."""
    splits = rows.groupBy("file", "start").agg(F.min("place").alias("place"))
    return splits.groupBy("file").agg(F.min(F.struct("start", "place")).alias("top")).select("file", "top.start", "top.place")


def sent(few: DataFrame) -> DataFrame:
    """A table with few rows for each file, to be joined with all records: sent to all tasks up to SENT_SPLITS rows."""
    few = staged(few)
    return F.broadcast(few) if few.count() <= SENT_SPLITS else few


def file_layouts(rows: DataFrame) -> DataFrame:
    """One row per file of the records of a folder: (file, records, first_fields, width, at_width, ragged, widest, first,
    second, second_fields).

    width is the field count that most records after the first have (the smaller one among equals); ragged counts those that
    have another. Blank lines do not count. All records are looked at; counts are summed per task before the shuffle."""
    rows = rows.where(present(F.col("record")))
    # whole numbers per split and width: summed by hash in each task, without sorting or moving records
    counts = staged(rows.groupBy("file", "start", "fields").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place")))
    firsts = sent(first_places(counts))
    later = rows.select("file", "start", "place").join(
        firsts.select("file", F.struct("start", "place").alias("top")), "file").where(F.struct("start", "place") > F.col("top"))
    heads = sent(firsts.withColumn("nth", F.lit(1)).unionByName(first_places(later).withColumn("nth", F.lit(2))))
    heads = staged(rows.join(heads, ["file", "start", "place"]).select("file", "nth", F.struct("record", "fields").alias("one")))
    top = heads.where("nth = 1").select("file", "one")
    two = heads.where("nth = 2").select("file", F.col("one.record").alias("second"), F.col("one.fields").alias("second_fields"))
    widths = counts.groupBy("file", "fields").agg(F.sum("n").alias("n")).join(top, "file").withColumn(
        "n", F.col("n") - (F.col("fields") == F.col("one.fields")).cast("bigint")).where("n > 0")
    usual = widths.groupBy("file").agg(
        F.max_by("fields", F.struct("n", -F.col("fields"))).alias("width"), F.max("n").alias("at_width"), F.sum("n").alias("below"),
        F.max("fields").alias("widest"))
    below, first_fields = F.coalesce("below", F.lit(0)), F.col("one.fields")
    return top.join(usual, "file", "left").join(two, "file", "left").select(
        "file", (below + 1).alias("records"), first_fields.alias("first_fields"), F.coalesce("width", first_fields).alias("width"),
        F.coalesce("at_width", F.lit(0)).alias("at_width"), (below - F.coalesce("at_width", F.lit(0))).alias("ragged"),
        F.coalesce("widest", first_fields).alias("widest"), F.col("one.record").alias("first"), "second", "second_fields")


def narrow_first() -> Column:
    """Whether the first record is far narrower than the others."""
    return (F.col("width") > 2 * F.col("first_fields")) & (F.col("width") - F.col("first_fields") >= 2)


def is_banner() -> Column:
    """Whether the first record is one field above a table in which all records have one width."""
    return narrow_first() & (F.col("first_fields") == 1) & (F.col("ragged") == 0)


def layout_report(rows: DataFrame) -> DataFrame:
    """What is unusual about each file: (file, records, width, ragged, first_fields, finding).

    banner: one field, then records that all have the usual width; malformed: a first record far narrower than the others
    that is no banner; disagrees: another width than most records of the folder have; ragged: records of other widths;
    otherwise plain."""
    files = staged(file_layouts(rows))
    usual = files.groupBy("width").agg(F.sum("at_width").alias("n")).orderBy(F.desc("n"), "width").first()
    most = F.lit(usual["width"] if usual else None)
    return files.select(
        F.element_at(F.split("file", "/"), -1).alias("file"), "records", "width", "ragged", "first_fields",
        F.when(is_banner(), "banner").when(narrow_first(), "malformed").when(F.col("width") != most, "disagrees")
        .when(F.col("ragged") > 0, "ragged").otherwise("plain").alias("finding"))
