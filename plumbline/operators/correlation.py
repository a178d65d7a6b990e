"""Pairwise Pearson correlation over pairwise-complete rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.operators.columns import ColumnInfo, numeric_columns, slice_key
from plumbline.session import small_table

PAIR_BATCH = 14
#: Numbers that a task keeps for its slices.
HELD_CELLS = 1 << 22
_PARTIAL = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def pair_r(x: Column, y: Column) -> Column:
    """Null-safe Pearson r of two columns; null for a constant or too few rows."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def correlatable(facts: DataFrame, cap: int | None = None) -> DataFrame:
    """Numeric columns worth correlating: more than one value; with a ``cap``, the largest variances."""
    usable = facts.where("role = 'numeric' AND nunique > 1")
    if cap is None:
        return usable.select("ordinal", "column")
    width = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(width.orderBy(F.desc("std"), "ordinal"))
    return usable.withColumn("rank", rank).where(F.col("rank") <= cap).select("ordinal", "column")


def _frame(mean: float | None, low: float | None, high: float | None) -> tuple[float, float]:
    """Shift and scale that bring a column's values into [-2, 2]; the sums of products then cannot overflow."""
    reach = max(abs(low or 0.0), abs(high or 0.0))
    center = mean if mean is not None and math.isfinite(mean) else 0.0
    return center, reach if 0 < reach < math.inf else 1.0


def _block(columns: Sequence[pa.Array]) -> np.ndarray:
    """The values of some columns side by side; missing ones are NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype("float64")


def _sums(block: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """For all pairs of columns: complete rows, sum of the first, sum of its squares, sum of products."""
    known = ~np.isnan(block)
    x = np.where(known, block / scale - center / scale, 0.0)
    m = known.astype("float64")
    return np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])


def _upper(sums: np.ndarray) -> list[np.ndarray]:
    """The sums of the pairs i < j, by the names of a partial row."""
    i, j = np.triu_indices(sums.shape[1], 1)
    return [i.astype("int32"), j.astype("int32"), sums[0][i, j], sums[1][i, j], sums[1][j, i], sums[2][i, j], sums[2][j, i],
            sums[3][i, j]]


_NAMES = ("i", "j", "n", "sx", "sy", "sxx", "syy", "sxy")


def _gram(frames: Sequence[tuple[float, float]]):
    """Per-task sums for all pairs: one small matrix product per Arrow batch."""
    center, scale = np.array(frames, dtype="float64").T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, len(center), len(center)))
        for batch in batches:
            sums += _sums(_block(batch.columns), center, scale)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _upper(sums)], names=list(_NAMES))

    return run


def _sliced_gram(frames: Sequence[tuple[float, float]], held: int = HELD_CELLS):
    """The same sums for each slice, in a dictionary of a task that is sent off whenever it holds so many numbers."""
    center, scale = np.array(frames, dtype="float64").T
    most = max(1, held // (4 * len(center) ** 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for slice_, own in sums.items():
                rows = _upper(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slice_] * len(rows[0]), pa.string()), *map(pa.array, rows)], names=["slice", *_NAMES])
            sums.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode("encode")
            at, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            order = np.argsort(at, kind="stable")
            block = _block(batch.columns[1:])[order]
            first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
            for begin, part in zip(first, np.split(block, first[1:])):
                slice_ = names[at[order[begin]]]
                own = _sums(part, center, scale)
                sums[slice_] = sums[slice_] + own if slice_ in sums else own
            if len(sums) > most:
                yield from out()
        yield from out()

    return run


def _frames(df: DataFrame, cols: Sequence[ColumnInfo]) -> dict[int, tuple[float, float]]:
    row = df.agg(*[
        f(c.number).alias(f"{k}{c.ordinal}") for c in cols for k, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))]).first()
    return {c.ordinal: _frame(*(row[f"{k}{c.ordinal}"] for k in ("m", "lo", "hi"))) for c in cols}


def _r_from_sums() -> Column:
    n = F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    spread = (vx > F.lit(1e-12) * F.col("sxx")) & (vy > F.lit(1e-12) * F.col("syy"))
    r = F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))
    finite = ~F.isnan(r) & (F.abs(r) < F.lit(float("inf")))
    return F.when((n > 1) & spread & finite, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def corr_pairs(
    df: DataFrame, cols: Sequence[ColumnInfo] | None = None, facts: DataFrame | None = None, by: str | None = None
) -> DataFrame:
    """(slice?, i, j, a, b, n, r) for the upper triangle, r unrounded.

    Without slices, each task reduces its rows to sums over all pairs (columns²
    numbers, whatever the rows), so one scan serves any number of pairs. Values
    are shifted by the column mean and scaled by the largest magnitude first,
    which keeps the sums finite and well-conditioned; r is null if a value is
    infinite.
    """
    cols = list(cols) if cols is not None else numeric_columns(df, by)
    if facts is not None and not by:
        keep = {r["ordinal"] for r in correlatable(facts).collect()}
        cols = [c for c in cols if c.ordinal in keep]
    spark = df.sparkSession
    if len(cols) < 2:
        return small_table(spark, [], ("slice string, " if by else "") + "i int, j int, a string, b string, n bigint, r double")
    if by:
        return _sliced_pairs(df, cols, by)
    if facts is not None:
        known = {r["ordinal"]: (r["mean"], r["min"], r["max"]) for r in facts.select("ordinal", "mean", "min", "max").collect()}
        frames = [_frame(*known.get(c.ordinal, (None, None, None))) for c in cols]
    else:
        frames = list(_frames(df, cols).values())
    sums = (
        df.select(*[c.number.alias(f"c{i}") for i, c in enumerate(cols)])
        .mapInArrow(_gram(frames), _PARTIAL)
        .groupBy("i", "j")
        .agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    )
    ordinal = F.array(*[F.lit(c.ordinal) for c in cols])
    name = F.array(*[F.lit(c.name) for c in cols])
    return sums.select(
        F.get(ordinal, F.col("i")).alias("i"), F.get(ordinal, F.col("j")).alias("j"),
        F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"),
        F.col("n").cast("bigint").alias("n"), _r_from_sums().alias("r"),
    )


def _sliced_pairs(df: DataFrame, cols: Sequence[ColumnInfo], by: str) -> DataFrame:
    """Sums per slice and pair. Each task reduces its rows to one small matrix per slice, so what is shuffled depends on
    slices and columns, not on rows; pairs without a complete row are left out."""
    frames = list(_frames(df, cols).values())
    sums = (
        df.select(*slice_key(by), *[c.number.alias(f"c{i}") for i, c in enumerate(cols)])
        .mapInArrow(_sliced_gram(frames), f"slice string, {_PARTIAL}")
        .groupBy("slice", "i", "j").agg(*[F.sum(k).alias(k) for k in _NAMES[2:]]).where("n > 0")
    )
    ordinal, name = (F.array(*[F.lit(getattr(c, k)) for c in cols]) for k in ("ordinal", "name"))
    return sums.select(
        "slice", F.get(ordinal, F.col("i")).alias("i"), F.get(ordinal, F.col("j")).alias("j"), F.get(name, F.col("i")).alias("a"),
        F.get(name, F.col("j")).alias("b"), F.col("n").cast("bigint").alias("n"), _r_from_sums().alias("r"))


def correlation_table(pairs: DataFrame) -> DataFrame:
    """Display form of the pairs, r at 4 places."""
    keys = ["slice"] if "slice" in pairs.columns else []
    return pairs.select(*keys, "a", "b", "n", F.round("r", 4).alias("r"))


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """Both triangles and the diagonal as (a, b, r) rows."""
    upper = pairs.select("a", "b", F.round("r", 4).alias("r"))
    names = upper.select("a").union(upper.select("b")).distinct()
    return (
        upper.unionByName(upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
        .unionByName(names.select("a", F.col("a").alias("b"), F.lit(1.0).alias("r")))
    )


def top_pairs(pairs: DataFrame, limit: int = vocab.MAX_SCATTERS) -> DataFrame:
    """Pairs with the largest |r|; ties in column order."""
    return (
        pairs.where("r IS NOT NULL")
        .orderBy(F.desc(F.abs("r")), "i", "j").limit(limit)
        .select("a", "b", F.round("r", 4).alias("r"))
    )


def strong_pairs(
    pairs: DataFrame, threshold: float = vocab.STRONG_PAIR_R, limit: int = vocab.STRONG_PAIR_LIMIT
) -> DataFrame:
    """Pairs with |r| at or above the threshold, strongest first, r at 2 places."""
    shown = F.round(F.col("r"), 4)
    return (
        pairs.where(F.abs(shown) >= threshold)
        .select("i", "j", "a", "b", F.round(shown, 2).alias("r"))
        .orderBy(F.desc(F.abs("r")), "i", "j").limit(limit).select("a", "b", "r")
    )


def leakage_flags(df: DataFrame, target: str, threshold: float = vocab.LEAKAGE_R) -> DataFrame:
    """Numeric features almost perfectly correlated with a numeric target."""
    cols = numeric_columns(df)
    goal = next((c for c in cols if c.name == target), None)
    features = [c for c in cols if c.name != target and not c.name.endswith("_missing")]
    schema = "ordinal int, column string, r double"
    spark = df.sparkSession
    if goal is None or not features:
        return small_table(spark, [], schema)
    out = None
    for start in range(0, len(features), PAIR_BATCH):
        batch = features[start : start + PAIR_BATCH]
        wide = df.agg(*[pair_r(c.number, goal.number).alias(f"r{c.ordinal}") for c in batch])
        part = wide.select(F.inline(F.array(*[
            F.struct(F.lit(c.ordinal).alias("ordinal"), F.lit(c.name).alias("column"), F.col(f"r{c.ordinal}").alias("r"))
            for c in batch
        ])))
        out = part if out is None else out.unionByName(part)
    return out.where(F.abs("r") > threshold)
