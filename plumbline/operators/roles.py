"""Identifier columns, target candidates and the kind of problem, decided from column facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.scalars import capitalised, has_word, name_tokens, two_places, whole_percent

NO_TARGET_ONE_COLUMN = "Dataset has only one column, so there is no feature/target split to supervise on."
NO_TARGET_AT_ALL = (
    "No column scored as a plausible prediction target (all columns look like "
    "identifiers or free text); treating this as unsupervised data."
)
NO_PROBLEM = (
    "No explicit target column detected. Dataset can be used for exploratory analysis, "
    "clustering, anomaly detection, or visualization."
)


def _keys(facts: DataFrame) -> list[str]:
    return ["slice"] if "slice" in facts.columns else []


def word_flags(facts: DataFrame) -> DataFrame:
    """Name tokens of each column and the word lists they meet."""
    tokens = name_tokens(F.col("column"))
    return facts.withColumns({
        "strong": has_word(tokens, vocab.STRONG_TARGET_WORDS),
        "metric": has_word(tokens, vocab.METRIC_WORDS),
        "feature": has_word(tokens, vocab.FEATURE_WORDS),
        "id_word": has_word(tokens, vocab.IDENTIFIER_WORDS),
        "tokens": F.concat_ws(" ", tokens),
    })


def is_sequential() -> Column:
    """A running index: whole, all distinct, without a gap."""
    return (
        (F.col("role") == "numeric") & (F.col("n") >= 2) & F.col("all_whole")
        & (F.col("nunique") == F.col("n")) & (F.col("span") == F.col("n") - 1)
    )


def is_identifier() -> Column:
    near_unique = ~F.col("is_numeric") & (F.col("nunique") > F.col("rows") * F.lit(vocab.ID_UNIQUENESS))
    return F.col("id_word") | F.coalesce(is_sequential(), F.lit(False)) | F.coalesce(near_unique, F.lit(False))


def identifier_columns(facts: DataFrame, target: str | None = None) -> DataFrame:
    """Columns that carry no signal: keys, running indexes, near-unique text."""
    flagged = word_flags(facts).where(is_identifier())
    if target is not None:
        flagged = flagged.where(F.col("column") != target)
    why = F.when(F.col("id_word"), "name").when(is_sequential(), "sequence").otherwise("uniqueness")
    return flagged.select(*_keys(facts), "ordinal", "column", why.alias("why"))


def _ratio() -> Column:
    return F.col("nunique") / F.col("n")


def series_type() -> Column:
    """Classification or regression, from type and cardinality alone."""
    few = (F.col("nunique") <= vocab.ALWAYS_CLASSES) | (
        (F.col("nunique") <= vocab.LOW_CARDINALITY) & (_ratio() < vocab.LOW_CARDINALITY_RATIO)
    )
    return F.when(~F.col("is_numeric") | few, "classification").otherwise("regression")


def target_candidates(facts: DataFrame) -> DataFrame:
    """Non-identifier, non-constant columns with their confidence as the target, best first.

    Scores are whole hundredths, so the order never depends on rounding.
    """
    usable = word_flags(facts).where((F.col("role") != "unsupported") & ~is_identifier() & (F.col("nunique") > 1))
    kind, ratio, distinct = series_type(), _ratio(), F.col("nunique").cast("string")
    metric = ~F.col("strong") & F.col("is_numeric") & F.col("metric")
    regression = kind == "regression"
    free_text = ~F.col("is_numeric") & (ratio > 0.5)
    points = (
        F.when(F.col("strong"), 55).when(metric, 30).otherwise(0)
        + F.when(F.col("feature"), -30).otherwise(0)
        + F.when(regression, F.lit(35) + F.when(ratio >= 0.5, 15).when(ratio >= 0.2, 8).otherwise(0))
        .when(F.col("nunique") == 2, 40).when(F.col("nunique") <= vocab.LOW_CARDINALITY, 25).otherwise(5)
        + F.when(free_text, -40).otherwise(0)
    )
    named = F.concat(F.lit("name '"), F.col("column"), F.lit("'"))
    reason = F.concat_ws(
        "; ",
        F.when(F.col("strong"), F.concat(named, F.lit(" matches a common target/label convention")))
        .when(metric, F.concat(named, F.lit(" is a business metric you'd typically predict"))),
        F.when(F.col("feature"), F.concat(
            named, F.lit(" looks like a descriptive feature (geography/time/contact), not a target"))),
        F.when(regression, F.concat(F.lit("continuous numeric with "), distinct, F.lit(" distinct values")))
        .when(F.col("nunique") == 2, F.lit("binary column -- a natural classification target"))
        .when(F.col("nunique") <= vocab.LOW_CARDINALITY, F.concat(
            F.lit("low-cardinality categorical ("), distinct, F.lit(" classes)")))
        .otherwise(F.concat(F.lit("high-cardinality categorical ("), distinct, F.lit(" values) -- weak as a target"))),
        F.when(free_text, F.concat(
            F.lit("values are nearly all distinct ("), whole_percent(ratio),
            F.lit(" unique) -- reads as free text, not a label"))),
    )
    keys = _keys(facts)
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("score"), "ordinal")
    return (
        usable.withColumn("type", kind)
        .withColumn("score", F.least(F.greatest(points, F.lit(0)), F.lit(100)))
        .withColumn("reason", capitalised(reason))
        .withColumn("rank", F.row_number().over(order))
        .select(*keys, "rank", "ordinal", "column", "type", "score",
                F.round(F.col("score") / 100, 2).alias("confidence"), "reason")
    )


def target_choice(facts: DataFrame) -> DataFrame:
    """The one target column (or none) of each table, with the reasoning.

    A column with an explicit target name wins even when it is degenerate, so
    that the validity gate can reject it; otherwise the best candidate wins if
    it reaches the minimum confidence.
    """
    keys = _keys(facts)
    scored = target_candidates(facts).select(*keys, "ordinal", "score", "reason")
    every = word_flags(facts).join(scored, [*keys, "ordinal"], "left")
    pick = F.struct(
        F.coalesce("score", F.lit(-1)).alias("score"), (-F.col("ordinal")).alias("order"), "column", "reason")
    grouped = every.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("columns"),
        F.count("score").alias("candidates"),
        F.max(F.when(F.col("strong"), pick)).alias("named"),
        F.max(F.when(F.col("score").isNotNull(), pick)).alias("best"),
    )
    named, best = F.col("named"), F.col("best")
    single = F.col("columns") < 2
    weak = best["score"] < vocab.MIN_TARGET_HUNDREDTHS

    def inferred(c: Column) -> Column:
        return F.concat(
            F.lit("Target inferred automatically based on dataset characteristics: '"), c["column"],
            F.lit("' (confidence "), two_places(c["score"] / 100), F.lit(") -- "), c["reason"], F.lit("."))

    target = (
        F.when(single, F.lit(None)).when(named.isNotNull(), named["column"])
        .when(best.isNotNull() & ~weak, best["column"])
    )
    reasoning = (
        F.when(single, F.lit(NO_TARGET_ONE_COLUMN))
        .when(named.isNotNull() & (named["score"] >= 0), inferred(named))
        .when(named.isNotNull(), F.concat(
            F.lit("Column '"), named["column"],
            F.lit("' matches a common target-naming convention, so it is treated as the intended target.")))
        .when(best.isNull(), F.lit(NO_TARGET_AT_ALL))
        .when(weak, F.concat(
            F.lit("No column scored as a plausible prediction target (highest candidate '"), best["column"],
            F.lit("' scored only "), two_places(best["score"] / 100), F.lit("); treating this as unsupervised data.")))
        .otherwise(inferred(best))
    )
    chosen = F.when(named.isNotNull(), F.greatest(named["score"], F.lit(0))).otherwise(best["score"])
    confidence = F.when(target.isNotNull(), F.round(chosen / 100, 2))
    return grouped.select(*keys, target.alias("target"), confidence.alias("confidence"),
                          F.when(single, 0).otherwise(F.col("candidates")).cast("bigint").alias("candidates"),
                          reasoning.alias("reasoning"))


def target_error() -> Column:
    """Why a target column cannot be learned from; null when it can."""
    quoted = F.concat(F.lit("Target column '"), F.col("column"), F.lit("'"))
    return F.when(F.col("n") == 0, F.concat(quoted, F.lit(" is entirely missing/null."))).when(
        F.col("nunique") <= 1,
        F.concat(quoted, F.lit(" contains only "), F.col("nunique").cast("string"), F.lit(" unique value(s) in "),
                 F.col("n").cast("string"),
                 F.lit(" non-null row(s). A predictive model cannot learn from a single-class target.")),
    )


def problem_type(facts: DataFrame, target: str | None) -> DataFrame:
    """(problem_type, reasoning) of a table for its target."""
    if target is None:
        return facts.limit(1).select(
            F.lit("unknown").alias("problem_type"), F.lit(NO_PROBLEM).alias("reasoning"))
    quoted = F.concat(F.lit("Target '"), F.col("column"), F.lit("'"))
    shape = F.concat(F.lit("("), F.col("nunique").cast("string"), F.lit(" unique values, "),
                     F.format_string("%.3f", F.round(_ratio(), 3)), F.lit(" unique/total ratio)"))
    error, kind = target_error(), series_type()
    reasoning = (
        F.when(error.isNotNull(), error)
        .when(~F.col("is_numeric"), F.concat(
            quoted, F.lit(" has dtype "), F.col("dtype"), F.lit(" (non-numeric) with "),
            F.col("nunique").cast("string"), F.lit(" unique values, so it's treated as a set of class labels.")))
        .when(kind == "classification", F.concat(
            quoted, F.lit(" is numeric but low-cardinality "), shape,
            F.lit(", consistent with encoded class labels rather than a continuous quantity.")))
        .otherwise(F.concat(
            quoted, F.lit(" is numeric with high cardinality "), shape, F.lit(", consistent with a continuous target.")))
    )
    return facts.where(F.col("column") == target).select(
        F.when(error.isNotNull(), "invalid").otherwise(kind).alias("problem_type"), reasoning.alias("reasoning"))
