import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plumbline as pb
from plumbline.streaming.admission import MICROS, admit
from plumbline.streaming.typed_state import admission_state, admission_state_stream, typed_state


def brute_force(times, limit, window):
    """The rule, event by event."""
    held, out = [], []
    for t in times:
        held = [h for h in held if h > t - window]
        if len(held) < limit:
            held.append(t)
            out.append((True, 0))
        else:
            out.append((False, max(1, int((window - (t - held[0])) / MICROS) + 1)))
    return out


@pytest.mark.parametrize("limit", [1, 2, 5])
@pytest.mark.parametrize("seed", range(4))
def test_admit_matches_the_rule(limit, seed):
    rng = random.Random(seed)
    times = sorted(rng.randrange(0, 400) * MICROS // 2 for _ in range(300))
    flags, retry, _ = admit(np.array(times), [], limit, 10 * MICROS)
    assert list(zip(flags.tolist(), retry.tolist())) == brute_force(times, limit, 10 * MICROS)


@pytest.fixture(scope="module")
def clicks(spark):
    """One key holds most events; the rest are sparse."""
    rng = random.Random(11)
    rows = [(i, "hot" if i % 3 else f"k{rng.randrange(8)}", rng.randrange(0, 5000)) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, who string, s long").select(
        "id", "who", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"))


def expected(clicks, limit, seconds):
    groups = {}
    for r in clicks.select("id", "who", F.unix_micros("ts").alias("us")).orderBy("us", "id").collect():
        groups.setdefault(r["who"], []).append((r["us"], r["id"]))
    return {
        i: d for events in groups.values()
        for (_, i), d in zip(events, brute_force([t for t, _ in events], limit, seconds * MICROS))}


@pytest.mark.parametrize("chunk_windows, busy_rows", [(2, 0), (4, 500), (16, 10**6)])
def test_audit_is_exact_for_any_chunking(clicks, chunk_windows, busy_rows):
    got = pb.admission_audit(clicks, "who", "ts", "id", 2, 400, chunk_windows, busy_rows)
    assert {r["id"]: (r["admitted"], r["retry_after"]) for r in got.collect()} == expected(clicks, 2, 400)


def test_closed_bucket_rejects_everything(clicks):
    got = pb.admission_audit(clicks, "who", "ts", "id", 0, 60).groupBy("admitted", "retry_after").count().collect()
    assert [tuple(r) for r in got] == [(False, 60, 1500)]


def test_stream_equals_batch(spark, clicks, tmp_path):
    path = str(tmp_path / "in")
    clicks.repartition(6).write.parquet(path)
    stream = spark.readStream.schema(clicks.schema).option("maxFilesPerTrigger", 2).parquet(path)
    query = (
        pb.admission_stream(stream, "who", "ts", "id", 2, 60, "2 hours").writeStream.format("memory")
        .queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    )
    query.processAllAvailable()
    # A far later event moves the watermark past everything held.
    clicks.limit(1).select(
        F.lit(10**6).cast("long").alias("id"), F.lit("late").alias("who"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts")
    ).coalesce(1).write.mode("append").parquet(path)
    query.processAllAvailable()
    query.stop()
    got = {r["id"]: (r["admitted"], r["retry_after"]) for r in spark.table("admitted").collect()}
    assert got == expected(clicks, 2, 60)


def test_typed_state(spark, clicks, tmp_path):
    """Rows in any order over several triggers, a null key and a null time; idle keys leave no state."""
    path, places = str(tmp_path / "in"), [str(tmp_path / name) for name in ("out", "state")]
    more = spark.createDataFrame([(5000, None, 1_700_000_100), (5001, None, 1_700_000_110), (5002, "k1", None)], "id long, who string, s long")
    rows = clicks.unionByName(more.select("id", "who", F.timestamp_seconds("s").alias("ts")))
    rows.repartition(5).write.parquet(path)

    def run(later=None):
        if later is not None:
            spark.range(1).select(F.lit(10**6).cast("long").alias("id"), F.lit("later").alias("who"),
                                  F.timestamp_seconds(F.lit(later)).alias("ts")).write.mode("append").parquet(path)
        stream = spark.readStream.schema(clicks.schema).option("maxFilesPerTrigger", 2).parquet(path)
        with typed_state(spark):
            admission_state_stream(stream, "who", "ts", "id", 2, 60, "2 hours").writeStream.format("parquet").option(
                "path", places[0]).option("checkpointLocation", places[1]).outputMode("append").trigger(
                availableNow=True).start().awaitTermination()
        return admission_state(spark, places[1], "who")

    waiting = run()
    assert waiting.where("kind = 'waiting'").count() == 1502 and waiting.where("kind = 'admitted'").count() == 0
    left = run(1_800_000_000).collect()
    assert [(r["who"], r["kind"]) for r in left] == [("later", "waiting")]
    got = {r["id"]: (r["admitted"], r["retry_after"]) for r in spark.read.parquet(places[0]).collect()}
    want = expected(rows.where("ts is not null"), 2, 60)
    assert got == want and got[5000] == got[5001] == (True, 0)
