"""Admission by composed functions of chunks against the rule, event by event."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.streaming.admission import MICROS
from plumbline.streaming.prefix import Segment, Steps, admission_by_prefix, carries, packed, taken
from tests.test_admission import brute_force


def walk(times, last, window):
    for t in times:
        if last is None or t >= last + window:
            last = t
    return last


@pytest.mark.parametrize("seed", range(6))
def test_functions_and_their_composition(seed):
    rng = random.Random(seed)
    for _ in range(150):
        window = rng.choice((1, 3, 10, 40))
        times = np.array(sorted(rng.randrange(200) for _ in range(rng.randint(0, 60))), "int64")
        cuts = sorted(rng.randrange(len(times) + 1) for _ in range(3))
        parts = np.split(times, cuts)
        whole = Steps.of(parts[0], window)
        for part in parts[1:]:
            whole = whole.then(Steps.of(part, window))
        start = int(times[0]) if len(times) else 0
        for last in [None, *range(start - 2 * window, start + 1)]:
            assert whole(last) == Steps.of(times, window)(last) == walk(times.tolist(), last, window)
            kept = times[taken(times, last, window)]
            assert (int(kept[-1]) if len(kept) else last) == walk(times.tolist(), last, window)
        assert len(whole.outs) <= max(1, len(times))


@pytest.fixture(scope="module")
def clicks(spark):
    """A hot key, a burst with many equal times, a null key and sparse keys; repeated rows."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else rng.choice(("a", "b", None, "burst")), rng.randrange(0, 900)) for i in range(1200)]
    rows += [(2000 + i, "burst", 450 + i % 3) for i in range(300)] + [(5, "hot", 17), (5, "hot", 17)]
    return spark.createDataFrame(rows, "id long, who string, s long").select(
        "id", "who", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts")).repartition(6)


def expected(clicks, limit, seconds):
    groups = {}
    for r in clicks.select("id", "who", F.unix_micros("ts").alias("us")).orderBy("us", "id").collect():
        groups.setdefault(r["who"], []).append((r["us"], r["id"]))
    return sorted((str(who), us, i, *d) for who, rows in groups.items()
                  for (us, i), d in zip(rows, brute_force([t for t, _ in rows], limit, seconds * MICROS)))


@pytest.mark.parametrize("limit, seconds, chunk_rows, fan_in", [(1, 10, 4, 2), (3, 60, 7, 5), (2, 5000, 11, 32), (5, 3, 1, 64), (2, 20, 10**6, 8)])
def test_audit(clicks, limit, seconds, chunk_rows, fan_in):
    got = admission_by_prefix(clicks, "who", "ts", "id", limit, seconds, chunk_rows, fan_in)
    assert sorted((str(r["who"]), r["us"], r["id"], r["admitted"], r["retry_after"])
                  for r in got.withColumn("us", F.unix_micros("ts")).collect()) == expected(clicks, limit, seconds)


def test_a_saturated_key_takes_few_rounds(spark):
    """1,000 chunks of one key that is never idle: 11 rounds at most, and every carry as if walked event by event."""
    rng = random.Random(1)
    window, n = 50, 1000
    times = np.cumsum([rng.randint(1, 9) for _ in range(n * 8)])
    parts = np.split(times, n)
    rows = [(i, "k", "k", True, None, Steps.of(p, window)) for i, p in enumerate(parts)]
    segments = spark.createDataFrame([(*r[:5], r[5].upto.tolist(), r[5].outs.tolist()) for r in rows],
                                     "place long, first string, last string, single boolean, fixed long, upto array<long>, outs array<long>")
    for fan_in in (4, 32):
        got, rounds = carries(segments, n, window, fan_in)
        want, last = {}, None
        for i, part in enumerate(parts):
            if last is not None:
                want[i] = last
            last = walk(part.tolist(), last, window)
        assert {r["place"]: r["carry"] for r in got.collect()} == want and rounds <= 11


def test_segments_of_several_keys():
    def segment(keys, times, window=10):
        single = len(keys) == 1
        steps = Steps.of(np.array(times, "int64"), window)
        return Segment(keys[0], keys[-1], single, None if single else steps(None), steps if single else Steps.of(np.zeros(0, "int64"), window))

    a, b, c = segment(["x"], [1, 5]), segment(["x", "y"], [3, 20]), segment(["y"], [25, 31])
    for whole in (a.then(b).then(c), a.then(b.then(c))):
        assert not whole.single and whole(100) == whole(None) == c(b(None)) == 31


def test_chunks_keep_every_row(clicks):
    rows = clicks.select(F.col("who").alias("key"), F.col("id").alias("ord"), F.unix_micros("ts").alias("us"))
    chunks = packed(rows, 13).orderBy("place").collect()
    assert [c["place"] for c in chunks] == list(range(len(chunks)))
    flat = [(c["keys"][i], us, o) for c in chunks for j, (us, o) in enumerate(zip(c["us"], c["ord"]))
            for i in [max(k for k, s in enumerate(c["starts"]) if s <= j)]]
    assert flat == sorted(((r["key"], r["us"], r["ord"]) for r in rows.collect()), key=lambda r: (r[0] is not None, r))


def test_limits(spark, clicks):
    assert admission_by_prefix(clicks.limit(0), "who", "ts", "id", 2, 10).count() == 0
    assert {(r["admitted"], r["retry_after"]) for r in admission_by_prefix(clicks, "who", "ts", "id", 0, 60).collect()} == {(False, 60)}
    with pytest.raises(ValueError):
        admission_by_prefix(clicks, "who", "ts", "id", 1, 0)
