"""Sliding-window admission: at most N admitted events per key in any trailing window.

An event is admitted when fewer than N events of its key were admitted in the
last W seconds; rejected events do not count. The decision depends only on the
key's last N admitted times, which expire after W.

Batch: the timeline of a busy key is cut into chunks of several windows, so that
the key spreads over many tasks. Every chunk first runs as if nothing came
before it; then each chunk whose true carry-in (the end state of the chunk
before it) differs is run again, until no carry-in changes. The result is
exact. Keys with few events are one group each and need none of this.

Stream: the same rule per key over event time, with rows held until the
watermark passes them and idle keys dropped by an event-time timeout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.columns import ref
from plumbline.session import cut_lineage

MICROS = 1_000_000
_FEW_KEYS = 100_000


def admit(ts: np.ndarray, carry: Iterable[int], limit: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decisions for one key's sorted times: admitted flags, retry seconds, admitted times with the carry.

    Steps from one admitted event to the next by binary search, so rejected
    events cost no Python step.
    """
    count = len(ts)
    before = np.array(sorted(carry)[-limit:], dtype="int64")
    accepted, picks, at = list(before), [], 0
    while at < count:
        if len(accepted) >= limit:
            at = max(at, int(np.searchsorted(ts, accepted[-limit] + window, side="left")))
            if at >= count:
                break
        picks.append(at)
        accepted.append(int(ts[at]))
        at += 1
    flags = np.zeros(count, dtype=bool)
    flags[picks] = True
    times = np.array(accepted, dtype="int64")
    retry = np.zeros(count, dtype="int64")
    rejected = ~flags
    if rejected.any():
        so_far = len(before) + np.cumsum(flags)
        oldest = times[so_far[rejected] - limit]
        wait = (window - (ts[rejected] - oldest)) / MICROS
        retry[rejected] = np.maximum(1, wait.astype("int64") + 1)
    return flags, retry, times


def _closed(df: DataFrame, window_seconds: float) -> DataFrame:
    return df.withColumn("admitted", F.lit(False)).withColumn(
        "retry_after", F.lit(max(1, int(window_seconds))).cast("bigint"))


def admission_audit(
    events: DataFrame,
    key: str,
    ts: str,
    order: str,
    limit: int,
    window_seconds: float,
    chunk_windows: int = 16,
    busy_rows: int = 1_000_000,
) -> DataFrame:
    """(key, order, ts, admitted, retry_after) for every event; ``order`` breaks ties in time.

    Keys with more than ``busy_rows`` events are handled in chunks of
    ``chunk_windows`` windows.
    """
    slim = events.select(ref(key).alias("key"), ref(order).alias("ord"), ref(ts).cast("timestamp").alias("ts"))
    named = [F.col("key").alias(key), F.col("ord").alias(order), F.col("ts").alias(ts)]
    if limit <= 0:
        return _closed(slim.select(*named), window_seconds)
    window = int(window_seconds * MICROS)
    span = window * chunk_windows
    rows = slim.withColumn("us", F.unix_micros("ts"))
    key_type = rows.schema["key"].dataType.simpleString()
    ord_type = rows.schema["ord"].dataType.simpleString()
    empty = F.array().cast("array<bigint>")

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["us", "ord"], kind="stable")

    def end_state(pdf: pd.DataFrame, carry: list[int]) -> pd.DataFrame:
        _, _, times = admit(in_order(pdf)["us"].to_numpy(), carry, limit, window)
        chunk = int(pdf["chunk"].iloc[0])
        alive = times[times > (chunk + 1) * span - window][-limit:]
        return pd.DataFrame({
            "key": [pdf["key"].iloc[0]], "chunk": [chunk], "carry": [carry], "left": [alive.tolist()]})

    def decide(pdf: pd.DataFrame, carry: list[int]) -> pd.DataFrame:
        pdf = in_order(pdf)
        flags, retry, _ = admit(pdf["us"].to_numpy(), carry, limit, window)
        return pd.DataFrame({
            "key": pdf["key"].to_numpy(), "ord": pdf["ord"].to_numpy(), "us": pdf["us"].to_numpy(),
            "admitted": flags, "retry_after": retry})

    decided_schema = f"key {key_type}, ord {ord_type}, us bigint, admitted boolean, retry_after bigint"
    state_schema = f"key {key_type}, chunk bigint, carry array<bigint>, left array<bigint>"

    def shown(decided: DataFrame) -> DataFrame:
        return decided.withColumn("ts", F.timestamp_micros("us")).select(*named, "admitted", "retry_after")

    def alone(part: DataFrame) -> DataFrame:
        """Decisions for keys that fit one group."""
        return shown(part.select("key", "ord", "us").groupBy("key").applyInPandas(
            lambda pdf: decide(pdf, []), decided_schema))

    def with_carry(part: DataFrame, carries: DataFrame, fn, schema: str) -> DataFrame:
        """Run a function on each chunk together with its one carry row."""
        left = part.select("key", "ord", "us", "chunk").groupBy("key", "chunk")
        right = carries.select("key", "chunk", "carry").groupBy("key", "chunk")
        return left.cogroup(right).applyInPandas(lambda pdf, c: fn(pdf, list(c["carry"].iloc[0])), schema)

    busy = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > busy_rows).select("key")
    busy_keys = busy.limit(_FEW_KEYS + 1).count()
    if busy_keys == 0:
        return alone(rows)
    busy = cut_lineage(busy)
    listed = F.broadcast(busy) if busy_keys <= _FEW_KEYS else busy
    quiet = rows.join(listed, "key", "left_anti")
    loud = rows.join(listed, "key", "left_semi").withColumn("chunk", F.floor(F.col("us") / F.lit(span)).cast("bigint"))

    first = loud.select("key", "ord", "us", "chunk").groupBy("key", "chunk")
    state = cut_lineage(first.applyInPandas(lambda pdf: end_state(pdf, []), state_schema))
    while True:
        ends = state.select("key", (F.col("chunk") + 1).alias("chunk"), F.col("left").alias("new_carry"))
        wrong = cut_lineage(
            state.join(ends, ["key", "chunk"], "left")
            .withColumn("new_carry", F.coalesce("new_carry", empty))
            .where(F.col("new_carry") != F.col("carry"))
            .select("key", "chunk", F.col("new_carry").alias("carry"))
        )
        if wrong.isEmpty():
            break
        redo = loud.join(wrong.select("key", "chunk"), ["key", "chunk"], "left_semi")
        again = with_carry(redo, wrong, end_state, state_schema)
        kept = state.join(wrong.select("key", "chunk"), ["key", "chunk"], "left_anti")
        state = cut_lineage(kept.unionByName(again))
    return alone(quiet).unionByName(shown(with_carry(loud, state, decide, decided_schema)))


def admission_summary(audit: DataFrame) -> DataFrame:
    """Totals of an audit: events, admitted, rejected, longest retry."""
    return audit.agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("admitted"), 1)).alias("admitted"),
        F.count(F.when(~F.col("admitted"), 1)).alias("rejected"), F.max("retry_after").alias("longest_retry"))


def admission_stream(
    events: DataFrame, key: str, ts: str, order: str, limit: int, window_seconds: float, lateness: str = "1 hour"
) -> DataFrame:
    """Streaming form with the same decisions for rows that arrive within ``lateness``.

    Rows wait in state until the watermark passes them, so arrival order does
    not matter; rows behind the watermark are dropped and counted by Spark. A
    key's state goes once its last admitted event has left the window.
    """
    if limit <= 0:
        return _closed(events.select(ref(key).alias(key), ref(order).alias(order), ref(ts).alias(ts)), window_seconds)
    window = int(window_seconds * MICROS)
    slim = (
        events.select(ref(key).alias("key"), ref(order).cast("bigint").alias("ord"), ref(ts).cast("timestamp").alias("ts"))
        .withWatermark("ts", lateness)
        .withColumn("us", F.unix_micros("ts"))
    )
    key_type = slim.schema["key"].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, held_us, held_ord = state.get if state.exists else ([], [], [])
        held = [pd.DataFrame({"us": list(held_us), "ord": list(held_ord)}, dtype="int64")]
        held += [f[["us", "ord"]] for f in frames]
        waiting = pd.concat(held).sort_values(["us", "ord"], kind="stable")
        mark = state.getCurrentWatermarkMs() * 1000
        ready = waiting[waiting["us"] < mark]
        waiting = waiting[waiting["us"] >= mark]
        flags, retry, times = admit(ready["us"].to_numpy(), list(carry), limit, window)
        carry = times[times > mark - window][-limit:]
        if len(waiting) or len(carry):
            state.update((carry.tolist(), waiting["us"].tolist(), waiting["ord"].tolist()))
            due = int(waiting["us"].iloc[0]) if len(waiting) else int(carry[-1]) + window
            state.setTimeoutTimestamp(max(due, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        if len(ready):
            yield pd.DataFrame({
                "key": [group[0]] * len(ready), "ord": ready["ord"].to_numpy(), "us": ready["us"].to_numpy(),
                "admitted": flags, "retry_after": retry})

    out = slim.select("key", "ord", "us", "ts").groupBy("key").applyInPandasWithState(
        step, f"key {key_type}, ord bigint, us bigint, admitted boolean, retry_after bigint",
        "carry array<bigint>, held_us array<bigint>, held_ord array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout)
    return out.select(
        F.col("key").alias(key), F.col("ord").alias(order), F.timestamp_micros("us").alias(ts), "admitted", "retry_after")
