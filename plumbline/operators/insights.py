"""Insight cards and the table overview, from profile tables. Identifier columns never win a card."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.scalars import band, fact, one_place, two_places
from plumbline.session import small_table


def without(table: DataFrame, names: Iterable[str], column: str = "column") -> DataFrame:
    """Rows whose column is not in a (schema-bounded) list of names."""
    names = list(names)
    if not names:
        return table
    drop = small_table(table.sparkSession, [(n,) for n in names], f"{column} string")
    return table.join(F.broadcast(drop), column, "left_anti")


def statistics_table(facts: DataFrame, identifiers: Iterable[str]) -> DataFrame:
    """Numeric summary without identifier columns."""
    return without(facts.where("role = 'numeric'"), identifiers).select(
        "column", *[fact(F.col(c)).alias(c) for c in ("mean", "median", "std", "min", "max")])


def _best(table: DataFrame, size: Column, keep: Column, position: int, title: str, value: Column, detail: Column,
          tie: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """One card: the row with the largest size, first in column order on ties; none if nothing qualifies."""
    key = F.struct(size, *[-F.col(t) for t in tie])
    top = table.where(keep).agg(F.max_by(F.struct(value.alias("value"), detail.alias("detail")), key).alias("card"))
    return top.where(F.col("card").isNotNull()).select(
        F.lit(position).alias("ordinal"), F.lit(title).alias("title"), "card.value", "card.detail")


def insight_cards(
    facts: DataFrame, pairs: DataFrame, frequencies: DataFrame, target: str | None, identifiers: Iterable[str] = ()
) -> DataFrame:
    """All cards with a signal, in fixed order: (ordinal, title, value, detail).

    ``pairs`` comes from ``corr_pairs``, ``frequencies`` from ``value_frequencies``: the rarest value counts, so all are needed.
    """
    ids = list(identifiers)
    kept = without(facts, ids)
    c = F.col
    pct = F.round(c("n_null") / c("rows") * 100, 2)
    r = F.round(c("r"), 4)
    shown = pairs.withColumn("r", r)
    open_pairs = without(without(shown, ids, "a"), ids, "b")
    cards = [
        _best(kept, pct, c("n_null") > 0, 1, "Biggest Missing Column", c("column"),
              F.concat(pct.cast("string"), F.lit("% of values are missing."))),
        _best(open_pairs, F.abs("r"), F.abs("r") > 0, 2, "Strongest Correlation",
              F.concat(c("a"), F.lit(" & "), c("b")),
              F.concat(F.lit("Correlation coefficient of "), two_places(c("r")), F.lit(".")), ("i", "j")),
    ]
    spread = frequencies.groupBy("column").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("k"))
    categorical = kept.where("role = 'categorical'").join(F.broadcast(spread), "column")
    ratio = c("lo") / c("hi")
    cards.append(_best(
        categorical, -ratio, (c("k") >= 2) & (ratio < 1), 3, "Most Imbalanced Feature", c("column"),
        F.concat(F.lit("Minority/majority ratio of "), two_places(ratio), F.lit("."))))
    cov = F.abs(F.try_divide(fact(c("std")), fact(c("mean"))))
    cards.append(_best(
        kept.where("role = 'numeric'"), cov, cov.isNotNull(), 4, "Highest Variance Feature", c("column"),
        F.concat(F.lit("Coefficient of variation "), two_places(cov), F.lit("."))))
    if target is not None:
        mine = shown.where((c("a") == target) | (c("b") == target)).select(
            F.when(c("a") == target, c("b")).otherwise(c("a")).alias("column"),
            F.when(c("a") == target, c("j")).otherwise(c("i")).alias("ordinal"), "r")
        cards.append(_best(
            without(mine, ids), F.abs("r"), F.abs("r") > 0, 5, "Most Important Numeric Feature", c("column"),
            F.concat(F.lit("Correlates "), two_places(c("r")),
                     F.lit(" with the target (proxy measure, not a trained importance score)."))))
    cards.append(_best(
        kept.where("role = 'categorical'"), c("nunique"), c("nunique").isNotNull(), 6, "Most Unique Category",
        c("column"), F.concat(c("nunique").cast("string"), F.lit(" distinct values."))))
    cards.append(_best(
        kept.where("role = 'numeric'"), c("outliers"), c("outliers") > 0, 7, "Largest Outlier Count", c("column"),
        F.concat(c("outliers").cast("string"), F.lit(" values fall outside the IQR fences."))))
    out = cards[0]
    for card in cards[1:]:
        out = out.unionByName(card)
    return out


def dataset_overview(
    facts: DataFrame, name: str, score: int, target: str | None = None, problem_type: str | None = None
) -> DataFrame:
    """One row: size, feature counts, target, problem type and readiness badge."""
    role = F.col("role")
    counts = facts.agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"),
        F.count(F.when(role == "numeric", 1)).alias("numeric_features"),
        F.count(F.when(role.isin("categorical", "datetime"), 1)).alias("categorical_features"))
    size = F.col("rows") * F.col("columns") * 8
    label = F.when(size >= 1e9, F.concat(F.lit("~"), one_place(size / 1e9), F.lit(" GB"))).when(
        size >= 1e6, F.concat(F.lit("~"), one_place(size / 1e6), F.lit(" MB"))).when(
        size >= 1e3, F.concat(F.lit("~"), one_place(size / 1e3), F.lit(" KB"))).otherwise(
        F.concat(F.lit("~"), size.cast("string"), F.lit(" B")))
    points = F.lit(score)
    return counts.select(
        F.lit(name).alias("dataset_name"), "rows", "columns", label.alias("memory_usage"), "numeric_features",
        "categorical_features", F.lit(target).cast("string").alias("detected_target"),
        F.lit(problem_type or "unknown").alias("problem_type"), points.alias("score"),
        band(points, vocab.READINESS_BANDS).alias("readiness"),
        band(points, vocab.READINESS_BANDS, 2).alias("readiness_detail"))
