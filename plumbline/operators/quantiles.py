"""Exact quantiles without holding a column in one task.

The order statistic of rank k is searched by narrowing a value range: each
round counts the rows of a range in bins (a small, map-side combined
aggregate), keeps the one bin that holds rank k, and stops when a range holds
few rows or a single value. Only that last, small range is sorted. Every count
is exact, so the result is exact; a round costs one column-pruned scan and its
shuffle carries bins, not rows. The first round bins by order of magnitude,
which leaves a range within a factor of about 2 whatever the tails; each later
round takes 12 of the 52 bits that are left, so six rounds always suffice.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.columns import ColumnInfo, slice_key
from plumbline.session import cut_lineage, small_table

Extent = tuple[int, float, float]

BINS = 4096
SORT_LIMIT = 200_000
MAX_ROUNDS = 7
COLUMN_BATCH = 16
#: Value ranges of all groups up to which they are sent to all tasks.
SENT_RANGES = 100_000
#: Logarithms of doubles lie between -745.2 and 709.8; infinity is put at the top.
_LOG_TOP, _LOG_SHIFT = 711.0, 746.0


def long_numbers(df: DataFrame, cols: Sequence[ColumnInfo], by: str | None = None) -> DataFrame:
    """One row (slice?, pos, v) per present numeric cell; pos indexes ``cols``."""
    return df.select(
        *slice_key(by), F.posexplode(F.array(*[c.number for c in cols])).alias("pos", "v")
    ).where(F.col("v").isNotNull())


def _magnitude(c: Column) -> Column:
    """Monotone in c, by order of magnitude: sign times the logarithm above that of the smallest double."""
    return F.when(c == 0, 0.0).otherwise(F.signum(c) * (F.least(F.log(F.abs(c)), F.lit(_LOG_TOP)) + _LOG_SHIFT))


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """Monotone bin of v in [lo, hi]: equal widths where the ends are within a factor of 4, else by order of magnitude."""
    near = ((lo > 0) & (hi / 4 <= lo)) | ((hi < 0) & (lo / 4 >= hi))
    near &= F.greatest(F.abs(lo), F.abs(hi)) < F.lit(float("inf"))
    low, high = _magnitude(lo), _magnitude(hi)
    share = F.when(near, F.try_divide(v - lo, hi - lo)).otherwise(F.try_divide(_magnitude(v) - low, high - low))
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS).cast("int"), F.lit(BINS - 1))


def _rank_of(p: float, n: int) -> tuple[int, int, float]:
    spot = p * (n - 1)
    low = math.floor(spot)
    return low, min(low + 1, n - 1), spot - low


def _between(a: float, b: float, share: float) -> float:
    if share == 0 or a == b:
        return a
    if math.isinf(a) or math.isinf(b):
        return a + b if math.isinf(a) and math.isinf(b) else a if math.isinf(a) else b
    return a + (b - a) * share


@dataclass(frozen=True)
class _Hunt:
    """Search for the value at rank k of one column, now known to lie in [lo, hi]."""

    pos: int
    k: int
    lo: float
    hi: float
    below: int
    inside: int

    @property
    def range(self) -> tuple[int, float, float]:
        return self.pos, self.lo, self.hi


def _scan_ranges(df: DataFrame, cols: Sequence[ColumnInfo], hunts: Sequence[_Hunt], binned: bool) -> list[_Hunt]:
    """One pass over all ranges: the bin (or the value) that holds each wanted rank."""
    ranges = sorted({h.range for h in hunts})
    cells = F.array(*[
        F.when(cols[pos].number.between(F.lit(lo), F.lit(hi)), cols[pos].number) for pos, lo, hi in ranges])
    rows = df.select(F.posexplode(cells).alias("at", "v")).where(F.col("v").isNotNull())

    def per_range(values: Sequence) -> Column:
        return F.get(F.array(*[F.lit(x) for x in values]), F.col("at"))

    if binned:
        lo, hi = per_range([r[1] for r in ranges]), per_range([r[2] for r in ranges])
        group = _bin(F.col("v"), lo, hi).alias("bin")
    else:
        group = F.col("v").alias("bin")
    order = Window.partitionBy("at").orderBy("bin")
    ranks = F.get(
        F.array(*[F.array(*[F.lit(h.k - h.below) for h in hunts if h.range == r]) for r in ranges]), F.col("at"))
    hits = (
        rows.groupBy("at", group)
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .withColumn("upto", F.sum("n").over(order))
        .where(F.exists(ranks, lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n"))))
        .collect()
    )
    out = []
    for h in hunts:
        rank = h.k - h.below
        hit = next(b for b in hits if ranges[b["at"]] == h.range and b["upto"] - b["n"] <= rank < b["upto"])
        out.append(_Hunt(h.pos, h.k, hit["lo"], hit["hi"], h.below + hit["upto"] - hit["n"], hit["n"]))
    return out


def column_quantiles(
    df: DataFrame,
    cols: Sequence[ColumnInfo],
    probs: Sequence[float],
    extents: Mapping[int, Extent],
    sort_limit: int = SORT_LIMIT,
) -> dict[int, list[float]]:
    """Linearly interpolated quantiles per column ordinal; columns without data are left out.

    ``extents`` has (n, min, max) per ordinal. The search state is a few numbers
    per column and stays on the driver; each round is one pass over a batch of
    columns.
    """
    out = {}
    for start in range(0, len(cols), COLUMN_BATCH):
        out.update(_batch_quantiles(df, cols[start : start + COLUMN_BATCH], probs, extents, sort_limit))
    return out


def _batch_quantiles(
    df: DataFrame, cols: Sequence[ColumnInfo], probs: Sequence[float], extents: Mapping[int, Extent], sort_limit: int
) -> dict[int, list[float]]:
    known = [(i, c, extents[c.ordinal]) for i, c in enumerate(cols) if extents.get(c.ordinal, (0,))[0]]
    hunts = [
        _Hunt(i, k, lo, hi, 0, n) for i, _, (n, lo, hi) in known
        for k in sorted({k for p in probs for k in _rank_of(p, n)[:2]})
    ]
    for _ in range(MAX_ROUNDS):
        wide = [h for h in hunts if h.inside > sort_limit and h.lo < h.hi]
        if not wide:
            break
        hunts = [h for h in hunts if h not in wide] + _scan_ranges(df, cols, wide, binned=True)
    rest = [h for h in hunts if h.lo < h.hi]
    if rest:
        hunts = [h for h in hunts if h.lo == h.hi] + _scan_ranges(df, cols, rest, binned=False)
    value = {(h.pos, h.k): h.lo for h in hunts}
    out = {}
    for i, c, (n, _, _) in known:
        out[c.ordinal] = []
        for p in probs:
            low, high, share = _rank_of(p, n)
            a, b = value[i, low], value[i, high]
            out[c.ordinal].append(_between(a, b, share))
    return out


def _ranks(p: float, n: Column) -> tuple[Column, Column, Column]:
    spot = F.lit(float(p)) * (n - 1)
    low = F.floor(spot)
    return low, F.least(low + 1, n - 1), spot - low


def sliced_order_statistics(long: DataFrame, wanted: DataFrame, keys: list[str], sort_limit: int = SORT_LIMIT) -> DataFrame:
    """The same search per group, with its state as a distributed table.

    ``wanted`` has keys, k, lo, hi (the group's extremes) and inside (its row
    count). Up to SENT_RANGES ranges are sent to all tasks, so that cells stay where
    they are and only bins are shuffled, however few the groups; more are joined by a
    shuffle, as there are many groups then.
    """
    few = wanted.count() <= SENT_RANGES  # never more ranges than wanted ranks
    group = [*keys, "lo", "hi"]
    wide = (F.col("inside") > sort_limit) & (F.col("lo") < F.col("hi"))
    rank = F.col("k") - F.col("below")
    hit = (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)

    def attach(s: DataFrame) -> DataFrame:
        ranges = s.select(*group).distinct()
        return long.join(F.broadcast(ranges) if few else ranges, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))

    state = wanted.withColumn("below", F.lit(0).cast("bigint"))
    if not state.where(wide).isEmpty():
        state = cut_lineage(state)
        for _ in range(MAX_ROUNDS):
            bins = (
                attach(state.where(wide))
                .groupBy(*group, _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi"))
                .withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("bin")))
            )
            narrowed = state.where(wide).join(bins, group).where(hit).select(
                *keys, "k", F.col("bin_lo").alias("lo"), F.col("bin_hi").alias("hi"), F.col("n").alias("inside"),
                (F.col("below") + F.col("upto") - F.col("n")).alias("below"))
            state = cut_lineage(state.where(~wide).unionByName(narrowed).select(*state.columns))
            if state.where(wide).isEmpty():
                break
    single = state.where(F.col("lo") == F.col("hi")).select(*keys, "k", F.col("lo").alias("v"))
    rest = state.where(F.col("lo") < F.col("hi"))
    values = (
        attach(rest).groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("v")))
    )
    return single.unionByName(rest.join(values, group).where(hit).select(*keys, "k", "v"))


def sliced_quantiles(
    df: DataFrame,
    cols: Sequence[ColumnInfo],
    probs: Sequence[float],
    extents: DataFrame,
    by: str,
    sort_limit: int = SORT_LIMIT,
) -> DataFrame:
    """(slice, ordinal, p0, p1, ...) from ``extents`` (slice, ordinal, n, min, max)."""
    keys = ["slice", "pos"]
    index = small_table(df.sparkSession, [(c.ordinal, i) for i, c in enumerate(cols)], "ordinal int, pos int")
    groups = (
        extents.join(F.broadcast(index), "ordinal").where(F.col("n") > 0)
        .select(*keys, "n", F.col("min").alias("lo"), F.col("max").alias("hi"))
    )
    ranks = [r for p in probs for r in _ranks(p, F.col("n"))[:2]]
    wanted = groups.select(
        *keys, F.explode(F.array_distinct(F.array(*ranks))).alias("k"), "lo", "hi", F.col("n").alias("inside"))
    found = sliced_order_statistics(long_numbers(df, cols, by), wanted, keys, sort_limit)
    picks = []
    for i, p in enumerate(probs):
        low, high, share = _ranks(p, F.col("n"))
        at_low = F.max(F.when(F.col("k") == low, F.col("v")))
        at_high = F.max(F.when(F.col("k") == high, F.col("v")))
        part = F.max(share)
        picks.append(F.when(part == 0, at_low).otherwise(at_low + (at_high - at_low) * part).alias(f"p{i}"))
    return (
        found.join(groups.select(*keys, "n"), keys).groupBy(*keys).agg(*picks)
        .join(F.broadcast(index), "pos").drop("pos")
    )
