"""Validity gate, quality score and its presentation tables, from column facts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.scalars import band, one_place, two_places
from plumbline.operators.roles import target_error
from plumbline.session import small_table


def validity_report(
    facts: DataFrame, duplicates: DataFrame, target: str | None, identifiers: Iterable[str] = ()
) -> DataFrame:
    """One row: valid, errors, warnings, duplicate_percentage.

    ``duplicates`` is the one-row result of ``duplicate_rows`` on the same table.
    """
    error = facts.where(F.col("column") == target).select(target_error().alias("e")).first() if target else None
    names = [r["column"] for r in facts.select("column").collect()]
    features = [n for n in names if n != target and n not in set(identifiers)]
    n, dup = F.col("rows"), F.col("duplicates")
    pct = F.when(n > 0, F.round(dup / n * 100, 2)).otherwise(0.0)
    errors = F.array_compact(F.array(
        F.when(n == 0, F.lit("The uploaded file has no data rows.")),
        F.lit("The uploaded file has no columns." if not names else None).cast("string"),
        F.when((n > 0) & (F.col("distinct_rows") < 2), F.lit(
            "After removing duplicate rows, fewer than 2 unique rows remain -- not enough data to analyze.")),
        F.lit(error["e"] if error else None).cast("string"),
        F.lit(
            "No usable feature columns remain: every column looks like an identifier (unique IDs, names, or free "
            "text) or the target. There is nothing for a model to learn from."
            if names and not features else None).cast("string"),
    ))
    warnings = F.array_compact(F.array(
        F.when(pct >= vocab.DUPLICATE_WARNING_PCT, F.concat(
            one_place(pct), F.lit("% of rows ("), dup.cast("string"),
            F.lit(") are exact duplicates; they will be removed during cleaning."))),
        F.when((n > 0) & (n < vocab.MIN_ROWS_WARNING), F.concat(
            F.lit("Only "), n.cast("string"),
            F.lit(" rows -- too little data for a reliable model recommendation; treat results as illustrative only."))),
        F.lit(
            "No clear target column was detected. The dataset will be analyzed for exploratory insights and "
            "clustering rather than supervised prediction."
            if target is None and features else None).cast("string"),
    ))
    return duplicates.select(
        (F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"),
        pct.alias("duplicate_percentage"))


def _shares(
    facts: DataFrame, duplicates: DataFrame, identifiers: Iterable[str]
) -> DataFrame:
    """One row of the raw counts behind the components."""
    role, ids = F.col("role"), list(identifiers)
    constant = ((role == "categorical") & (F.coalesce("nunique", F.lit(0)) <= 1)) | (
        (role == "numeric") & F.coalesce(F.col("min") == F.col("max"), F.lit(False)))
    dead = constant | (F.col("column").isin(ids) if ids else F.lit(False))
    eligible = (role == "numeric") & (F.col("nunique") > 2)
    row = facts.agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("n_null").alias("missing"),
        F.coalesce(F.sum(F.when(eligible, F.col("outliers"))), F.lit(0)).alias("outliers"),
        F.count(F.when(eligible, 1)).alias("eligible"), F.count(F.when(~dead, 1)).alias("usable"),
    )
    counts = row.first().asDict() | {"duplicates": duplicates.first()["duplicates"]}
    return small_table(
        facts.sparkSession, [counts],
        "rows bigint, columns bigint, missing bigint, outliers bigint, eligible bigint, usable bigint, duplicates bigint")


def quality_score(
    facts: DataFrame,
    duplicates: DataFrame,
    target: str | None = None,
    problem_type: str | None = None,
    identifiers: Iterable[str] = (),
    balance: DataFrame | None = None,
) -> DataFrame:
    """One row: the 0-100 score, the five components (0-100) and the issues in weight order.

    ``balance`` is ``class_balance`` of the target; it counts only for a
    categorical classification target, as a numeric one has no frequency table.
    """
    categorical = target is not None and problem_type == "classification" and not facts.where(
        (F.col("column") == target) & (F.col("role") == "categorical")).isEmpty()
    classes = balance.where(F.col("column") == target).first() if categorical and balance is not None else None
    known = classes is not None and classes["classes"] >= 2
    ratio = F.lit(classes["minority"] / classes["majority"] if known else 1.0)
    least = F.lit(classes["minority"] / classes["total"] if known else 1.0)

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    missing = share(F.col("missing"), F.col("rows") * F.col("columns"))
    repeated = share(F.col("duplicates"), F.col("rows"))
    outside = share(F.col("outliers"), F.col("rows") * F.col("eligible"))
    features = share(F.col("usable"), F.col("columns"))
    parts = {
        "missing_values": F.greatest(F.lit(0.0), 1 - missing),
        "duplicates": F.greatest(F.lit(0.0), 1 - repeated),
        "outliers": F.greatest(F.lit(0.0), 1 - outside),
        "feature_quality": features,
        "class_balance": F.least(F.lit(1.0), ratio / vocab.IMBALANCE_RATIO),
    }
    total = F.lit(0.0)
    for key, weight, _ in vocab.QUALITY_COMPONENTS:
        total = total + parts[key] * weight
    issues = F.array_compact(F.array(
        F.when(missing > vocab.ISSUE_SHARE, F.concat(
            F.lit("High missing values: "), one_place(missing * 100), F.lit("% of all cells are empty."))),
        F.when(repeated > vocab.ISSUE_SHARE, F.concat(
            F.lit("Duplicate rows: "), one_place(repeated * 100), F.lit("% of rows ("),
            F.col("duplicates").cast("string"), F.lit(") are exact duplicates."))),
        F.when(outside > vocab.ISSUE_SHARE, F.concat(
            F.lit("Outliers: "), one_place(outside * 100), F.lit("% of numeric values fall outside the IQR fences."))),
        F.when(features < vocab.FEATURE_ISSUE_SHARE, F.concat(
            F.lit("Low feature quality: "), (F.col("columns") - F.col("usable")).cast("string"), F.lit(" of "),
            F.col("columns").cast("string"),
            F.lit(" columns are identifiers or constant and carry no modeling signal."))),
        F.when(ratio < vocab.IMBALANCE_RATIO, F.concat(
            F.lit(f"Target imbalance: the smallest class of '{target}' is only "), one_place(least * 100),
            F.lit("% of rows (minority/majority ratio "), two_places(ratio), F.lit(")."))),
    ))
    return _shares(facts, duplicates, identifiers).select(
        F.bround(total * 100, 0).cast("int").alias("quality_score"),
        *[F.bround(c * 100, 0).cast("int").alias(k) for k, c in parts.items()],
        issues.alias("issues"),
    )


def quality_components(score: DataFrame) -> DataFrame:
    """One row per component: score, colour and plain explanation."""
    def explain(key: str) -> Column:
        s = F.least(F.greatest(F.col(key), F.lit(0)), F.lit(100))
        rest = (100 - s).cast("string")
        if key == "missing_values":
            return F.when(s >= 50, F.concat(F.lit("Only "), rest, F.lit("% of cells are missing."))).otherwise(
                F.concat(rest, F.lit("% of cells are missing.")))
        if key == "duplicates":
            return F.concat(rest, F.lit("% of rows are exact duplicates."))
        if key == "outliers":
            return F.concat(rest, F.lit("% of numeric values fall outside the IQR fences."))
        if key == "feature_quality":
            return F.concat(rest, F.lit("% of columns are identifiers or constant and carry no modeling signal."))
        return F.when(s < 100, F.lit(
            "The minority class is underrepresented relative to the majority class.")).otherwise(
            F.lit("The target classes are well balanced."))

    return score.select(F.inline(F.array(*[
        F.struct(
            F.lit(i + 1).alias("ordinal"), F.lit(key).alias("component"), F.lit(label).alias("label"),
            F.lit(weight).alias("weight"), F.col(key).alias("score"),
            band(F.col(key), vocab.COLOR_BANDS).alias("status_color"), explain(key).alias("explanation"))
        for i, (key, weight, label) in enumerate(vocab.QUALITY_COMPONENTS)
    ])))


def quality_bands(score: DataFrame) -> DataFrame:
    """One row: status, health and readiness texts of the overall score."""
    s = F.col("quality_score")
    return score.select(
        s, band(s, vocab.STATUS_BANDS).alias("status"), band(s, vocab.STATUS_BANDS, 2).alias("status_detail"),
        band(s, vocab.HEALTH_BANDS).alias("health"), band(s, vocab.HEALTH_BANDS, 2).alias("health_detail"),
        band(s, vocab.READINESS_BANDS).alias("readiness"), band(s, vocab.READINESS_BANDS, 2).alias("readiness_detail"))


def issue_cards(score: DataFrame) -> DataFrame:
    """Each issue with severity, impact and recommendation."""
    cards = small_table(
        score.sparkSession, vocab.ISSUE_CARDS, "prefix string, severity string, impact string, recommendation string")
    issues = score.select(F.posexplode("issues").alias("pos", "issue"))
    matched = issues.withColumn("prefix", F.regexp_extract("issue", "^([A-Za-z ]+):", 1))
    return matched.join(F.broadcast(cards), "prefix", "left").select(
        (F.col("pos") + 1).alias("ordinal"), "issue",
        F.coalesce("severity", F.lit("Medium")).alias("severity"),
        F.coalesce("impact", F.lit("May affect model reliability.")).alias("impact"),
        F.coalesce("recommendation", F.lit("Review this column before modeling.")).alias("recommendation"))
