"""Sliding-window admission over a stream with typed state variables and event-time timers.

The decisions are those of ``admission_stream``. Each key has two list states, the admitted times that still count and the
rows that wait for the watermark, and one timer for the next moment at which something happens: a waiting row is passed by
the watermark, or the last admitted time leaves the window. At that moment the lists are rewritten; when both are empty the
key has no state and no timer left. The state can be read back from the checkpoint while the stream is stopped or runs.

State is kept by RocksDB, so it need not fit in memory, and a lost executor's state is restored from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.columns import ref
from plumbline.streaming.admission import MICROS, _closed, admit

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ADMITTED, WAITING = "admitted", "waiting"


@contextmanager
def typed_state(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which typed state variables need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Admission(StatefulProcessor):
    """The rule for one key; times in microseconds, timers in milliseconds of event time."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState(ADMITTED, "us bigint")
        self.waiting = handle.getListState(WAITING, "us bigint, ord bigint")

    def _wake(self, due: int) -> None:
        """A timer at the due moment, unless an earlier one is set, which will see to it."""
        if all(t > due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            self.waiting.appendList(list(zip(pdf["us"].tolist(), pdf["ord"].tolist())))
            first = min(int(pdf["us"].min()), first if first is not None else int(pdf["us"].min()))
        if first is not None:
            self._wake(max(first // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark_ms = timerValues.getCurrentWatermarkInMs()
        mark = mark_ms * 1000
        waiting = np.array(sorted(self.waiting.get()), dtype="int64").reshape(-1, 2)
        at = int(np.searchsorted(waiting[:, 0], mark))
        ready, rest = waiting[:at], waiting[at:]
        flags, retry, times = admit(ready[:, 0], [us for (us,) in self.admitted.get()], self.limit, self.window)
        carry = times[times > mark - self.window][-self.limit :]
        for state, left in ((self.admitted, [(us,) for us in carry.tolist()]), (self.waiting, [tuple(r) for r in rest.tolist()])):
            if left:
                state.put(left)
            else:
                state.clear()
        if len(rest) or len(carry):
            due = int(rest[0, 0]) if len(rest) else int(carry[-1]) + self.window
            self._wake(max(due // 1000, mark_ms) + 1)
        if len(ready):
            yield pd.DataFrame({"key": [key[0]] * len(ready), "ord": ready[:, 1], "us": ready[:, 0],
                                "admitted": flags, "retry_after": retry})

    def close(self) -> None:
        pass


def admission_state_stream(
    events: DataFrame, key: str, ts: str, order: str, limit: int, window_seconds: float, lateness: str = "1 hour"
) -> DataFrame:
    """Streaming admission on typed state; start it inside ``typed_state(spark)``.

    Rows wait in state until the watermark passes them, so arrival order does not matter; rows behind the watermark are
    dropped and counted by Spark. Rows without a time are dropped.
    """
    if limit <= 0:
        return _closed(events.select(ref(key).alias(key), ref(order).alias(order), ref(ts).alias(ts)), window_seconds)
    slim = (
        events.select(ref(key).alias("key"), ref(order).cast("bigint").alias("ord"), ref(ts).cast("timestamp").alias("ts"))
        .where("ts is not null").withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    )
    key_type = slim.schema["key"].dataType.simpleString()
    out = slim.groupBy("key").transformWithStateInPandas(
        Admission(limit, int(window_seconds * MICROS)),
        f"key {key_type}, ord bigint, us bigint, admitted boolean, retry_after bigint", "Append", "EventTime")
    return out.select(
        F.col("key").alias(key), F.col("ord").alias(order), F.timestamp_micros("us").alias(ts), "admitted", "retry_after")


def admission_state(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, kind, ts): what each key holds in the state of a stream's last batch; kind is admitted or waiting."""
    def held(name: str) -> DataFrame:
        rows = (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
                .option("flattenCollectionTypes", True).load())
        return rows.select(F.col("key.key").alias(key), F.lit(name).alias("kind"),
                           F.timestamp_micros("list_element.us").alias("ts"))

    return held(ADMITTED).unionByName(held(WAITING))
