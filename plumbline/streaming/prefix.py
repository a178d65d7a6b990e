"""Sliding-window admission in a bounded number of rounds, whatever the keys: chunks as functions, composed in a tree.

At most N events of a key may be admitted in a trailing window W. Think of N servers that each take an event and are busy
for W. An event is admitted when any server is free, and since all are busy equally long it does not matter which one takes
it. Let the first free one in a fixed order take it: server 1 then takes every event that finds it free, server 2 every
event that server 1 left and that finds server 2 free, and so on. Each server sees one number, the time at which it last
took an event. A chunk of sorted events is for one server a function from that number to that number, and it is piecewise
constant: the number decides only which of the chunk's events is taken first.

So events are sorted once by ranges of (key, time), which splits a hot key and a burst alike, and packed into chunks. For
each server the chunks' functions are composed in a tree of groups of ``fan_in``, the tree is walked down again with the
true numbers, and the chunks learn their carry-in: 2 log(chunks) / log(fan_in) rounds. A last pass decides every chunk by
itself. Nothing is repeated until it settles, so a key that is saturated all the time costs as much as any other.

A function has at most as many pieces as the key has events within one window from the start of the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.operators.columns import ref
from plumbline.session import cut_lineage, small_table, staged
from plumbline.streaming.admission import MICROS, _closed, admit

#: Chunks up to which carries are sent to all tasks instead of being joined by a shuffle.
SENT_CHUNKS = 200_000


# --- functions of chunks ----------------------------------------------------------


@dataclass(frozen=True)
class Steps:
    """For one server: the first ``upto`` that is not before last + window gives the new last; beyond all, last stays."""

    upto: np.ndarray
    outs: np.ndarray
    window: int

    @classmethod
    def of(cls, times: np.ndarray, window: int) -> Steps:
        """The function of sorted times. Successors (the next time that is a window later) are doubled to their ends."""
        if not len(times):
            return cls(times, times, window)
        after = np.searchsorted(times, times + window)
        succ = np.where(after < len(times), after, np.arange(len(times)))
        while True:
            further = succ[succ]
            if np.array_equal(further, succ):
                break
            succ = further
        n = min(len(times), int(after[0]) + 1)  # a last taken time is not after the first of these
        return cls(times[:n], times[succ[:n]], window).merged()

    def merged(self) -> Steps:
        """Neighbouring pieces with one result become one."""
        last = np.append(self.outs[1:] != self.outs[:-1], True)[: len(self.outs)]
        return Steps(self.upto[last], self.outs[last], self.window)

    def __call__(self, last: int | None) -> int | None:
        at = 0 if last is None else int(np.searchsorted(self.upto, last + self.window))
        return int(self.outs[at]) if at < len(self.outs) else last

    def then(self, later: Steps) -> Steps:
        """One function for this chunk and the one after it."""
        at = np.searchsorted(later.upto, self.outs + self.window)
        inside = at < len(later.outs)
        outs = self.outs.copy()
        outs[inside] = later.outs[at[inside]]
        beyond = int(np.searchsorted(later.upto, self.upto[-1], "right")) if len(self.upto) else 0
        return Steps(np.concatenate((self.upto, later.upto[beyond:])), np.concatenate((outs, later.outs[beyond:])),
                     self.window).merged()


def taken(times: np.ndarray, last: int | None, window: int) -> np.ndarray:
    """Which of the sorted times a server takes."""
    out = np.zeros(len(times), dtype=bool)
    after = np.searchsorted(times, times + window).tolist()
    at = 0 if last is None else int(np.searchsorted(times, last + window))
    while at < len(times):
        out[at] = True
        at = after[at]
    return out


@dataclass(frozen=True)
class Segment:
    """A stretch of chunks: its first and last key, and what it makes of the number it is given. With a single key that is
    its function; otherwise its last key began inside, and the number is fixed."""

    first: object
    last: object
    single: bool
    fixed: int | None
    steps: Steps

    def __call__(self, carry: int | None) -> int | None:
        return self.steps(carry) if self.single else self.fixed

    def passes(self, carry: int | None, after: Segment) -> int | None:
        """The carry of the segment after this one, given this one's."""
        return self(carry) if self.last == after.first else None

    def then(self, after: Segment) -> Segment:
        if self.single and after.single and self.last == after.first:
            return Segment(self.first, after.last, True, None, self.steps.then(after.steps))
        # If this one is single, its result matters only for a key that goes on, which the line above has dealt with,
        # or for a segment that is not single and does not ask for it.
        return Segment(self.first, after.last, False, after(self.passes(None, after)), Steps.of(np.zeros(0, "int64"), self.steps.window))


def _segments(rows: pa.Table, window: int) -> list[Segment]:
    return [Segment(r["first"], r["last"], r["single"], r["fixed"],
                    Steps(np.array(r["upto"], "int64"), np.array(r["outs"], "int64"), window)) for r in rows.to_pylist()]


def _row(place: int, s: Segment) -> dict:
    return {"place": place, "first": s.first, "last": s.last, "single": s.single, "fixed": s.fixed,
            "upto": s.steps.upto.tolist(), "outs": s.steps.outs.tolist()}


def carries(segments: DataFrame, n: int, window: int, fan_in: int) -> tuple[DataFrame, int]:
    """(place, carry) for the n segments at places 0, 1, 2 ... that are given a number, and the rounds that took."""
    struct = segments.schema
    schema = to_arrow_schema(struct)
    given = T.StructType.fromDDL("place bigint, carry bigint")
    arrow_given = to_arrow_schema(given)

    def compose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        parts = _segments(rows, window)
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.then(part)
        return pa.Table.from_pylist([_row(rows["place"][0].as_py() // fan_in, whole)], schema)

    def spread(rows: pa.Table, above: pa.Table | None = None) -> pa.Table:
        rows = rows.sort_by("place")
        carry = above["carry"][0].as_py() if above is not None and above.num_rows else None
        out, parts = [], _segments(rows, window)
        for i, (place, part) in enumerate(zip(rows["place"].to_pylist(), parts)):
            if carry is not None:
                out.append({"place": place, "carry": carry})
            if i + 1 < len(parts):
                carry = part.passes(carry, parts[i + 1])
        return pa.Table.from_pylist(out, arrow_given)

    levels, rounds = [segments], 0
    while n > fan_in:
        levels.append(cut_lineage(levels[-1].groupBy(F.expr(f"place div {fan_in}")).applyInArrow(compose, struct)))
        n, rounds = -(-n // fan_in), rounds + 1
    top = levels.pop()  # one group of at most fan_in segments
    down = cut_lineage(top.groupBy(F.expr(f"place div {fan_in}")).applyInArrow(lambda rows: spread(rows), given))
    rounds += 1
    while levels:
        below = levels.pop()
        left = below.groupBy(F.expr(f"place div {fan_in}"))
        down = cut_lineage(left.cogroup(down.groupBy("place")).applyInArrow(lambda rows, above: spread(rows, above), given))
        rounds += 1
    return down, rounds


# --- chunks -------------------------------------------------------------------------


def packed(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Rows (key, ord, us) sorted by key, time and ord over ranges, in chunks: (place, keys, starts, us, ord), one key and
    start for each run of rows with one key. Places are 0, 1, 2 ... in the order of the rows."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    struct = T.StructType.fromDDL(
        f"at bigint, keys array<{kinds['key']}>, starts array<int>, us array<bigint>, ord array<{kinds['ord']}>")
    schema = to_arrow_schema(struct)

    def one(value: pa.Array, kind: pa.ListType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value.cast(kind.value_type), type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def chunks(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal at
            while held and sum(b.num_rows for b in held) >= least:
                table = pa.Table.from_batches(held).combine_chunks()
                own = table.slice(0, chunk_rows)
                held[:] = table.slice(chunk_rows).to_batches()
                runs = pc.run_end_encode(own["key"].combine_chunks(), run_end_type=pa.int32())
                starts = np.append(0, np.asarray(runs.run_ends)[:-1])
                values = [runs.values, pa.array(starts, pa.int32()), own["us"].combine_chunks(), own["ord"].combine_chunks()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), *[one(v, schema.field(i + 1).type) for i, v in enumerate(values)]], schema=schema)
                at += 1

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from chunks(chunk_rows)
        yield from chunks(1)

    order = ["key", "us", "ord"]
    chunks = staged(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, struct))
    sizes = chunks.groupBy(F.shiftright("at", 32).alias("range")).count().orderBy("range").collect()  # one row a task
    before, starts = 0, []
    for r in sizes:
        starts.append((r["range"], before))
        before += r["count"]
    starts = small_table(rows.sparkSession, starts, "range bigint, before bigint")
    return chunks.join(F.broadcast(starts), F.shiftright("at", 32) == F.col("range")).select(
        (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 32) - 1))).alias("place"), "keys", "starts", "us", "ord")


def _arrays(batch: pa.RecordBatch, name: str) -> Iterator[pa.Array]:
    column = batch.column(batch.schema.get_field_index(name))
    for i in range(batch.num_rows):
        yield column[i].values


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, list, list[np.ndarray], list[int | None]]]:
    """(place, keys, times of each run, the servers' numbers at the start of the first run)."""
    places, numbers = batch.column("place").to_pylist(), batch.column("carry").to_pylist()
    for place, keys, starts, us, carry in zip(places, *(_arrays(batch, c) for c in ("keys", "starts", "us")), numbers):
        yield place, keys.to_pylist(), np.split(us.to_numpy(), starts.to_numpy()[1:]), carry or []


def admission_by_prefix(
    events: DataFrame, key: str, ts: str, order: str, limit: int, window_seconds: float, chunk_rows: int = 1 << 15,
    fan_in: int = 32,
) -> DataFrame:
    """(key, order, ts, admitted, retry_after) for every event that has a time; ``order`` breaks ties in time.

    The same decisions as ``admission_audit``. A null key is a key like others.
    """
    slim = events.select(ref(key).alias("key"), ref(order).alias("ord"), ref(ts).cast("timestamp").alias("ts")).where("ts is not null")
    named = [F.col("key").alias(key), F.col("ord").alias(order), F.col("ts").alias(ts)]
    if limit <= 0:
        return _closed(slim.select(*named), window_seconds)
    window = int(window_seconds * MICROS)
    if window <= 0 or fan_in < 2:
        raise ValueError("a window above zero and a fan-in of two or more are needed")
    rows = slim.withColumn("us", F.unix_micros("ts"))
    chunks = packed(rows, chunk_rows)
    n = chunks.count()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    first_struct = T.StructType.fromDDL(
        f"place bigint, first {kinds['key']}, last {kinds['key']}, single boolean, fixed bigint, upto array<bigint>, outs array<bigint>")
    first_schema = to_arrow_schema(first_struct)

    def with_carry(columns: list[str], known: DataFrame | None) -> DataFrame:
        if known is None:
            return chunks.select(*columns, F.lit(None).cast("array<bigint>").alias("carry"))
        return chunks.select(*columns).join(F.broadcast(known) if n <= SENT_CHUNKS else known, "place", "left")

    def segment(server: int):
        """Each chunk as a segment for one server, with what the servers before it leave."""
        def left(times: np.ndarray, carry: list[int | None]) -> np.ndarray:
            for i in range(server):
                times = times[~taken(times, carry[i] if i < len(carry) else None, window)]
            return times

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for place, keys, times, carry in _runs(batch):
                    single = len(keys) == 1
                    steps = Steps.of(left(times[0], carry) if single else np.zeros(0, "int64"), window)
                    fixed = None if single else Steps.of(left(times[-1], []), window)(None)
                    yield pa.RecordBatch.from_pylist([_row(place, Segment(keys[0], keys[-1], single, fixed, steps))], first_schema)

        return run

    known: DataFrame | None = None
    for server in range(limit if n > 1 else 0):
        segments = cut_lineage(with_carry(["place", "keys", "starts", "us"], known).mapInArrow(segment(server), first_struct))
        own, _ = carries(segments, n, window, fan_in)
        if known is None:
            known = own.select("place", F.array("carry").alias("carry"))
        else:
            # servers before this one may be free where this one is not, and the other way round
            pad = F.coalesce("carry", F.array(*[F.lit(None).cast("bigint")] * server))
            known = known.join(own.withColumnRenamed("carry", "next"), "place", "full").select(
                "place", F.concat(pad, F.array("next")).alias("carry"))
        known = cut_lineage(known)

    struct = T.StructType.fromDDL(f"key {kinds['key']}, ord {kinds['ord']}, us bigint, admitted boolean, retry_after bigint")
    schema = to_arrow_schema(struct)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, _, times, carry), keys, starts, ords in zip(
                    _runs(batch), *(_arrays(batch, c) for c in ("keys", "starts", "ord"))):
                found = [admit(t, [c for c in carry if c is not None] if i == 0 else [], limit, window) for i, t in enumerate(times)]
                at = np.repeat(np.arange(len(times)), [len(t) for t in times])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at)), ords, pa.array(np.concatenate(times)), pa.array(np.concatenate([f[0] for f in found])),
                     pa.array(np.concatenate([f[1] for f in found]))], schema=schema)

    out = with_carry(["place", "keys", "starts", "us", "ord"], known).mapInArrow(decide, struct)
    return out.withColumn("ts", F.timestamp_micros("us")).select(*named, "admitted", "retry_after")
