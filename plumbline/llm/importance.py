"""Importance resampling towards a target: n-gram features in hashed buckets, gains per bucket, a draw without replacement.

A table of 256 bytes lower-cases A-Z and blanks every ASCII byte that is no letter and no digit; bytes.split then gives the
words of a text in UTF-8. The CRC-32 of a word is the seed from which the CRC-32 of the run one word longer goes on, so runs
of any length cost one call per word and are never joined as text. Each task reduces its features to counts in a Counter and
then to one row per bucket; Spark adds up the tasks. A bucket's gain compares its share in the target with its share in the
documents, a document's weight is the mean gain of its features, and its score adds Gumbel noise from the hash of its id, so
that the highest scores are a draw without replacement with odds exp(weight / 1000).

What comes to the driver is bounded whatever the corpus: one count per bucket, one count per score (scores are whole numbers
in a range set by the 64 bits of counts and the 32 bits of noise, below 120,000 values), and one count per partition of the
drawn rows. Ranks come from a range partitioning of the candidates above the score that the draw reaches, not from one task.

Defined results: null and empty texts have no features, weight 0 and are never drawn (unless least_words is 0); a null doc_id
is hashed as the empty string and comes last among equal scores; equal scores go to the smaller doc_id, then to fewer
features, then to the smaller weight, and rows that are equal in all of these are interchangeable; repeated rows are counted
and drawn each; empty documents give an empty table; an empty target leaves t and T at 0; other columns do not matter."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.text import per_text, slices, staged
from plumbline.session import small_table

#: For each byte what it becomes: a-z for A-Z, itself for digits, a-z and all bytes from 0x80 on, else a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Different features that a task counts before it folds them into buckets.
FOLD = 1 << 18


@dataclass(frozen=True)
class Draw:
    """Runs of up to `longest` words in `buckets` buckets; percent of the documents with least_words are drawn by `seed`."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def seeds(own: list[bytes], longest: int) -> Iterator[list[int]]:
    """For each length the CRC-32 of the runs of so many words, joined by one space, by where they start."""
    now = list(map(zlib.crc32, own))
    yield now
    spaced = [b" " + w for w in own] if longest > 1 else []
    for n in range(1, longest):
        now = list(map(zlib.crc32, spaced[n:], now))
        yield now


def bucket_counts(df: DataFrame, how: Draw) -> DataFrame:
    """(bucket, n): how many features of the texts fall into each bucket."""
    struct = T.StructType.fromDDL("bucket int, n long")
    schema = to_arrow_schema(struct)

    def run(batches):
        sums, counts = np.zeros(how.buckets, np.int64), Counter()

        def fold():
            at = np.fromiter(counts.keys(), np.int64, len(counts)) % how.buckets
            np.add.at(sums, at, np.fromiter(counts.values(), np.int64, len(counts)))
            counts.clear()

        for batch in batches:
            for _, texts in slices(batch, "text"):
                for text in texts:
                    for own in seeds(words(text), how.longest):
                        counts.update(own)
                if len(counts) > FOLD:
                    fold()
        fold()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], schema=schema)

    slim = df.select(F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, struct).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Per bucket floor(1000 ln(((t+1) / (T+buckets)) / ((s+1) / (S+buckets)))), multiplied out, in doubles."""
    total, wanted = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * total / ((source.get(b, 0) + 1) * wanted))) for b in range(buckets)]


def noise(seed: str, doc_id: int | None) -> int:
    """Gumbel noise in thousandths from the first 32 bits of the hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: list[int], how: Draw) -> DataFrame:
    """Per document: words, features, weight and score."""
    def start():
        table = np.array(gain, np.int64)

        def work(rows, texts):
            out = {c: [] for c in ("n_words", "n_features", "weight", "score")}
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts):
                n, total = 0, 0
                own = words(text)
                for found in seeds(own, how.longest):
                    n += len(found)
                    total += int(table[np.array(found, np.int64) % how.buckets].sum())
                out["n_words"].append(len(own))
                out["n_features"].append(n)
                out["weight"].append(total // n if n else 0)
                out["score"].append(out["weight"][-1] + noise(how.seed, doc_id))
            yield {"doc_id": rows.column("doc_id"), **out}

        return work

    return per_text(docs, "text", {"doc_id": F.col("doc_id").cast("long")}, start,
                    "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """The rows with their place 1, 2, 3 ... in the order, as `rank`: sorted by ranges, then counted on per range."""
    inside = (1 << 33) - 1
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("at", 33).alias("range")).count().orderBy("range").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["range"], before))
        before += r["count"]
    starts = small_table(rows.sparkSession, starts, "range long, before long")
    return placed.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("range")).withColumn(
        "rank", F.col("before") + F.col("at").bitwiseAND(F.lit(inside)) + 1).drop("at", "range", "before")


def draw(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """Every document with its words, features, weight, score, and its rank in the draw (null: not drawn)."""
    source, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(df, how).collect()} for df in (docs, target))
    rows = staged(weighed(docs, gains(source, wanted, how.buckets), how))
    fit = F.col("n_words") >= how.least_words
    by_score = rows.where(fit).groupBy("score").count().orderBy(F.desc("score")).collect()
    most = how.percent * sum(r["count"] for r in by_score) // 100
    reached, cut = 0, None
    for r in by_score:
        if reached < most:
            reached, cut = reached + r["count"], r["score"]
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    near = fit & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    top = ranked(rows.where(near), order).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return top.unionByName(rows.where(~near).withColumn("rank", F.lit(None).cast("long")))
