"""Column facts: one row per column (and slice) with every statistic the decisions need.

Passes, each column-pruned: a wide aggregate (counts, moments, extremes), a
grouped count for distinct values, the quantile search, and a conditional sum
for values outside the IQR fences.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import fact, is_whole
from plumbline.operators.columns import (
    BOOLEAN, DATETIME, NUMERIC, UNSUPPORTED, ColumnInfo, columns_of, slice_key,
)
from plumbline.operators.quantiles import SENT_RANGES, column_quantiles, long_numbers, sliced_quantiles
from plumbline.session import cut_lineage, small_table, together

BATCH = 16
CELL_BATCH = 32
LONG_TEXT = 64
_FACTS = (
    "ordinal int, column string, dtype string, role string, is_numeric boolean, rows bigint, n_null bigint, "
    "n bigint, nunique bigint, mean double, std double, min double, max double, span double, all_whole boolean, "
    "q1 double, median double, q3 double, lower double, upper double, outliers bigint"
)


def _moments(df: DataFrame, cols: Sequence[ColumnInfo], by: str | None) -> DataFrame:
    """Wide aggregate over one batch of columns, turned into one row per column."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    packed = []
    for c in cols:
        i, v = c.ordinal, c.value
        aggs.append(F.count(v).alias(f"n{i}"))
        fields = [F.lit(i).alias("ordinal"), F.col(f"n{i}").alias("n")]
        if c.kind == NUMERIC:
            d = c.number
            aggs += [
                F.avg(d).alias(f"avg{i}"), F.stddev_samp(d).alias(f"std{i}"),
                F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"),
            ]
            if c.is_integral:
                whole = F.col(f"n{i}") > 0
            else:
                aggs.append(F.min(is_whole(v).cast("int")).alias(f"whole{i}"))
                whole = F.coalesce(F.col(f"whole{i}") == 1, F.lit(False))
            low, high = F.col(f"min{i}"), F.col(f"max{i}")
            fields += [
                F.col(f"avg{i}").alias("mean"), F.col(f"std{i}").alias("std"),
                low.cast("double").alias("min"), high.cast("double").alias("max"),
                F.try_subtract(high, low).cast("double").alias("span"), whole.alias("all_whole"),
            ]
        else:
            null = F.lit(None).cast("double")
            fields += [null.alias(k) for k in ("mean", "std", "min", "max", "span")]
            fields.append(F.lit(False).alias("all_whole"))
        packed.append(F.struct(*fields))
    keys = ["slice"] if by else []
    wide = df.groupBy(*slice_key(by)).agg(*aggs)
    return wide.select(*keys, "rows", F.inline(F.array(*packed)))


def basic_facts(df: DataFrame, by: str | None = None) -> DataFrame:
    """Counts, moments and extremes of every column, in batches of ``BATCH`` columns per aggregate."""
    cols = columns_of(df, by)
    if not cols:  # no column, no row
        none = df.select(*[F.col(c) for c in df.columns], F.lit(0).alias("none"))
        return _moments(none, [c for c in columns_of(none, by)], by).where(F.lit(False))
    parts = [_moments(df, cols[i : i + BATCH], by) for i in range(0, len(cols), BATCH)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _cells(df: DataFrame, cols: Sequence[ColumnInfo], values: Sequence[Column], by: str | None) -> DataFrame:
    """(slice?, pos, v): one row per present cell, in batches that keep the generated code small."""
    keys = ["slice"] if by else []
    out = None
    for start in range(0, len(cols), CELL_BATCH):
        part = df.select(
            *slice_key(by), F.posexplode(F.array(*values[start : start + CELL_BATCH])).alias("pos", "v")
        ).select(*keys, (F.col("pos") + start).alias("pos"), "v").where(F.col("v").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def _grouped(df: DataFrame, cols: Sequence[ColumnInfo], values: Sequence[Column], by: str | None) -> DataFrame:
    keys = ["slice"] if by else []
    ordinal = F.get(F.array(*[F.lit(c.ordinal) for c in cols]), F.col("pos"))
    return (
        _cells(df, cols, values, by).groupBy(*keys, "pos", "v").agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, ordinal.alias("ordinal"), "v", "n")
    )


def _families(cols: Sequence[ColumnInfo]) -> list[list[ColumnInfo]]:
    groups = ([c for c in cols if c.family == f and c.kind != UNSUPPORTED] for f in ("bigint", "double", "string"))
    return [g for g in groups if g]


def value_counts(df: DataFrame, cols: Sequence[ColumnInfo], by: str | None = None) -> list[DataFrame]:
    """Per type family: (slice?, ordinal, v, n), the rows of each distinct present value.

    Counts combine on the map side, so a hot value costs one row per task.
    """
    return [_grouped(df, members, [c.family_value for c in members], by) for members in _families(cols)]


def _short(c: ColumnInfo) -> Column:
    """Stand-in for counting distinct values: a long text becomes its SHA-256, so it is not shuffled whole."""
    if c.family != "string":
        return c.family_value
    v = c.family_value
    return F.when(F.length(v) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(v, 256))).otherwise(v)


def distinct_counts(df: DataFrame, cols: Sequence[ColumnInfo], by: str | None = None, approx: bool = False) -> DataFrame:
    """(slice?, ordinal, nunique) of non-null values; exact unless ``approx``."""
    keys = ["slice"] if by else []
    usable = [c for c in cols if c.kind != UNSUPPORTED]
    if approx:
        wide = df.groupBy(*slice_key(by)).agg(
            *[F.approx_count_distinct(c.family_value, 0.01).alias(f"u{c.ordinal}") for c in usable]
        )
        packed = [F.struct(F.lit(c.ordinal).alias("ordinal"), F.col(f"u{c.ordinal}").alias("nunique")) for c in usable]
        return wide.select(*keys, F.inline(F.array(*packed)))
    parts = [
        _grouped(df, members, [_short(c) for c in members], by)
        .groupBy(*keys, "ordinal").agg(F.count(F.lit(1)).alias("nunique"))
        for members in _families(usable)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _approx_quantiles(df: DataFrame, cols: Sequence[ColumnInfo], by: str | None) -> DataFrame:
    wide = df.groupBy(*slice_key(by)).agg(
        *[F.percentile_approx(c.number, [0.25, 0.5, 0.75], 10_000).alias(f"s{c.ordinal}") for c in cols]
    )
    packed = [
        F.struct(
            F.lit(c.ordinal).alias("ordinal"),
            *[F.element_at(F.col(f"s{c.ordinal}"), i + 1).alias(f"p{i}") for i in range(3)],
        )
        for c in cols
    ]
    return wide.select(*(["slice"] if by else []), F.inline(F.array(*packed)))


def outlier_counts(df: DataFrame, cols: Sequence[ColumnInfo], fences: Mapping[int, tuple[float, float]]) -> dict[int, int]:
    """Values strictly outside [lower, upper] per ordinal, in one conditional count."""
    kept = [c for c in cols if c.ordinal in fences]
    if not kept:
        return {}
    out = {}
    for start in range(0, len(kept), CELL_BATCH):
        batch = kept[start : start + CELL_BATCH]
        row = df.agg(*[
            F.count(F.when((c.number < fences[c.ordinal][0]) | (c.number > fences[c.ordinal][1]), 1)).alias(f"o{c.ordinal}")
            for c in batch
        ]).first()
        out.update({c.ordinal: row[f"o{c.ordinal}"] for c in batch})
    return out


def sliced_outlier_counts(df: DataFrame, cols: Sequence[ColumnInfo], fences: DataFrame, by: str) -> DataFrame:
    """(slice, ordinal, outliers) from fences (slice, ordinal, lower, upper)."""
    index = small_table(df.sparkSession, [(c.ordinal, i) for i, c in enumerate(cols)], "ordinal int, pos int")
    bounds = fences.join(F.broadcast(index), "ordinal").select("slice", "pos", "ordinal", "lower", "upper")
    bounds = F.broadcast(bounds) if fences.count() <= SENT_RANGES else bounds
    outside = (F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))
    return (
        long_numbers(df, cols, by).join(bounds, ["slice", "pos"])
        .groupBy("slice", "ordinal").agg(F.sum(outside.cast("bigint")).alias("outliers"))
    )


def _role(c: ColumnInfo, date_columns: Sequence[str]) -> str:
    if c.kind in (NUMERIC, UNSUPPORTED):
        return c.kind
    return "datetime" if c.kind == DATETIME or c.name in date_columns else "categorical"


def _sliced_facts(df: DataFrame, by: str, approx: bool, distinct: bool, quantiles: bool, labels: DataFrame) -> DataFrame:
    cols = columns_of(df, by)
    numeric = [c for c in cols if c.kind == NUMERIC]
    keys = ["slice", "ordinal"]
    out = basic_facts(df, by)
    if distinct and any(c.kind != UNSUPPORTED for c in cols):
        out = out.join(distinct_counts(df, cols, by, approx), keys, "left")
        out = out.withColumn("nunique", F.coalesce("nunique", F.when(F.col("n") == 0, 0)))
    else:
        out = out.withColumn("nunique", F.lit(None).cast("bigint"))
    if quantiles and numeric:
        out = cut_lineage(out)
        found = _approx_quantiles(df, numeric, by) if approx else sliced_quantiles(
            df, numeric, (0.25, 0.5, 0.75), out, by)
        out = out.join(found, keys, "left").withColumnsRenamed({"p0": "q1", "p1": "median", "p2": "q3"})
        reach = 1.5 * (F.col("q3") - F.col("q1"))
        eligible = F.col("nunique") > 2 if distinct else F.col("q1").isNotNull()
        out = cut_lineage(
            out.withColumn("lower", F.when(eligible, F.col("q1") - reach))
            .withColumn("upper", F.when(eligible, F.col("q3") + reach)))
        out = out.join(sliced_outlier_counts(df, numeric, out.where(F.col("lower").isNotNull()), by), keys, "left")
    else:
        null = F.lit(None).cast("double")
        out = out.withColumns({k: null for k in ("q1", "median", "q3", "lower", "upper")})
        out = out.withColumn("outliers", F.lit(None).cast("bigint"))
    out = out.join(F.broadcast(labels), "ordinal").withColumn("n_null", F.col("rows") - F.col("n"))
    return out.select("slice", *[f.strip().split(" ")[0] for f in _FACTS.split(",")])


def column_facts(
    df: DataFrame,
    by: str | None = None,
    mode: str = "exact",
    distinct: bool = True,
    quantiles: bool = True,
    date_columns: Sequence[str] = (),
) -> DataFrame:
    """All facts of ``df``, per slice of ``by`` when given.

    Without ``by`` the result has one row per column and is computed at once;
    with ``by`` it stays a distributed table. ``mode="approx"`` swaps distinct
    counts and quantiles for bounded sketches.
    """
    cols = columns_of(df, by)
    numeric = [c for c in cols if c.kind == NUMERIC]
    spark, approx = df.sparkSession, mode == "approx"
    rows = {
        c.ordinal: {
            "ordinal": c.ordinal, "column": c.name, "dtype": c.dtype.simpleString(), "role": _role(c, date_columns),
            "is_numeric": c.kind in (NUMERIC, BOOLEAN)}
        for c in cols
    }
    if by:
        labels = small_table(
            spark, rows.values(), "ordinal int, column string, dtype string, role string, is_numeric boolean")
        return _sliced_facts(df, by, approx, distinct, quantiles, labels)

    usable = [c for c in cols if c.kind != UNSUPPORTED]
    counting = [lambda: distinct_counts(df, usable, None, approx).collect()] if distinct and usable else []
    basic, *counted = together(lambda: basic_facts(df).collect(), *counting)
    for r in basic:
        rows[r["ordinal"]].update(r.asDict(), n_null=r["rows"] - r["n"])
    if counting:
        for c in usable:
            rows[c.ordinal]["nunique"] = 0
        for r in counted[0]:
            rows[r["ordinal"]]["nunique"] = r["nunique"]
    if quantiles and numeric:
        if approx:
            found = {r["ordinal"]: [r["p0"], r["p1"], r["p2"]] for r in _approx_quantiles(df, numeric, None).collect()
                     if r["p0"] is not None}
        else:
            extents = {c.ordinal: tuple(rows[c.ordinal][k] for k in ("n", "min", "max")) for c in numeric}
            found = column_quantiles(df, numeric, (0.25, 0.5, 0.75), extents)
        fences = {}
        for i, (q1, median, q3) in found.items():
            rows[i].update(q1=q1, median=median, q3=q3)
            if not counting or rows[i]["nunique"] > 2:
                fences[i] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
                rows[i].update(lower=fences[i][0], upper=fences[i][1])
        for i, n in outlier_counts(df, numeric, fences).items():
            rows[i]["outliers"] = n
    # One partition: everything decided from these few rows runs without a shuffle.
    return small_table(spark, rows.values(), _FACTS).coalesce(1)


# --- views over the facts ----------------------------------------------------


def _keys(facts: DataFrame) -> list[str]:
    return ["slice"] if "slice" in facts.columns else []


def missing_profile(facts: DataFrame) -> DataFrame:
    """Columns with missing cells, their number and percentage."""
    return facts.where("n_null > 0").select(
        *_keys(facts), "column", "n_null", F.round(F.col("n_null") / F.col("rows") * 100, 2).alias("null_pct")
    )


def numeric_summary(facts: DataFrame) -> DataFrame:
    return facts.where("role = 'numeric'").select(
        *_keys(facts), "column", "n", "nunique",
        *[fact(F.col(c)).alias(c) for c in ("mean", "median", "std", "min", "max")],
    )


def outlier_summary(facts: DataFrame) -> DataFrame:
    """Fences and outlier counts of the numeric columns with more than two distinct values."""
    return facts.where("role = 'numeric' AND nunique > 2").select(
        *_keys(facts), "column", F.col("outliers").alias("outliers"),
        fact(F.col("lower")).alias("lower_bound"), fact(F.col("upper")).alias("upper_bound"),
    )


def uniqueness(facts: DataFrame) -> DataFrame:
    return facts.select(*_keys(facts), "column", "nunique", fact(F.col("nunique") / F.col("rows")).alias("uniqueness"))


def skew_table(facts: DataFrame) -> DataFrame:
    """Skew proxy |mean - median| / std and coefficient of variation per numeric column."""
    return facts.where("role = 'numeric'").select(
        *_keys(facts), "column",
        fact(F.try_divide(F.abs(F.col("mean") - F.col("median")), F.col("std"))).alias("skew"),
        fact(F.abs(F.try_divide(F.col("std"), F.col("mean")))).alias("cv"),
    )


def table_totals(facts: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and outliers of the whole table."""
    return facts.groupBy(*_keys(facts)).agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"),
        F.sum("n_null").alias("missing_cells"), F.coalesce(F.sum("outliers"), F.lit(0)).cast("bigint").alias("outliers"),
    )
