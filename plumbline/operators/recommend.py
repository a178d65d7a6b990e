"""Heuristic ranking of model families from column facts. No model is trained."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.scalars import capitalised, grouped_digits, small_percent, two_places
from plumbline.session import small_table

# --- fixed values: scoring rules ---------------------------------------------
# model, signal, kind (add | floor), points, position of the reason, reason.
# {rows}, {rows_grouped}, {categorical} and {balance} are filled per table.

_TREES = ("Gradient Boosting", "Random Forest", "XGBoost")
_STRONG = "strong on structured tabular data with non-linear relationships"
_LINEAR = "a simple, highly interpretable linear baseline"


def _rules(trees: dict[str, str], linear: str, lightgbm: str, catboost: str, baseline: str, imbalance: bool) -> list[tuple]:
    gb, rf, xgb = (trees[t] for t in _TREES)
    rules = [
        (gb, "always", "add", 3.0, 10, _STRONG),
        (rf, "always", "add", 2.0, 10, _STRONG),
        (rf, "always", "add", 0.0, 11, baseline),
        (xgb, "always", "add", 2.0, 10, _STRONG),
        (linear, "always", "add", 1.0, 10, _LINEAR),
        (xgb, "large", "add", 4.0, 20, "excels on large datasets ({rows_grouped} rows)"),
        (lightgbm, "large", "add", 5.5, 20, "scales efficiently to large datasets ({rows_grouped} rows)"),
        (catboost, "large", "add", 5.0, 20, "handles large tabular data well with strong defaults"),
        (catboost, "categorical_heavy", "floor", 6.0, 0,
         "handles the many categorical features ({categorical}) natively without heavy encoding"),
        (xgb, "categorical_heavy", "add", 2.0, 30, "handles mixed categorical/numeric features well"),
        (gb, "categorical_heavy", "add", 1.0, 30, None),
        (linear, "small", "add", 1.5, 0,
         "the small dataset ({rows} rows) makes this simple, interpretable model a competitive baseline"),
        (xgb, "small", "add", -1.0, 35,
         "the small dataset ({rows} rows) gives this data-hungry booster less room to shine; it benefits from more "
         "data and tuning"),
        (linear, "outliers", "add", -1.0, 40, "more sensitive to the outliers detected in this dataset"),
    ]
    for tree in (gb, rf, xgb):
        rules.append((tree, "outliers", "add", 1.0, 40, "robust to the outliers found in the profile"))
        rules.append((tree, "mixed", "add", 1.0, 50,
                      "handles higher-dimensional mixed features without heavy preprocessing"))
        if imbalance:
            rules.append((tree, "imbalanced", "add", 0.5, 60, "{balance}"))
    return rules


CLASSIFICATION_RULES = _rules(
    {t: t for t in _TREES}, "Logistic Regression", "LightGBM", "CatBoost",
    "robust baseline that needs little tuning and is easy to interpret via feature importances", True)
REGRESSION_RULES = _rules(
    {t: f"{t} Regressor" for t in _TREES}, "Linear Regression", "LightGBM Regressor", "CatBoost Regressor",
    "robust baseline requiring minimal tuning", False)

# Order of models on equal scores.
CLASSIFICATION_ORDER = ("Gradient Boosting", "Random Forest", "XGBoost", "Logistic Regression", "LightGBM", "CatBoost")
REGRESSION_ORDER = (
    "Gradient Boosting Regressor", "Random Forest Regressor", "XGBoost Regressor", "Linear Regression",
    "LightGBM Regressor", "CatBoost Regressor")

SIGNAL_NAMES = ("small", "large", "mixed", "categorical_heavy", "outliers", "missing", "skewed", "imbalanced")


def signals(facts: DataFrame, target: str | None, balance: DataFrame | None = None) -> DataFrame:
    """One row of table characteristics; ``balance`` is ``class_balance`` of the target."""
    feature = (F.col("column") != target) if target is not None else F.lit(True)
    numeric = F.col("role") == "numeric"
    other = F.col("role").isin("categorical", "datetime")
    spread = F.when(numeric & (F.col("std") > 0), F.abs(F.col("mean") - F.col("median")) / F.col("std"))
    raw = facts.agg(
        F.max("rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"),
        F.count(F.when(feature & numeric, 1)).alias("n_numeric"),
        F.count(F.when(feature & other, 1)).alias("n_categorical"),
        F.coalesce(F.sum("outliers"), F.lit(0)).alias("n_outliers"),
        F.sum("n_null").alias("n_missing"),
        F.coalesce(F.avg(spread), F.lit(0.0)).alias("skew"),
    )
    classes = balance.where(F.col("column") == target).first() if balance is not None and target else None
    known = classes is not None and classes["classes"] >= 2
    ratio = classes["minority"] / classes["majority"] if known else None
    c = F.col
    return raw.select(
        "n_rows", "n_columns", "n_numeric", "n_categorical", "n_outliers", "n_missing",
        (c("n_rows") <= vocab.SMALL_ROWS).alias("small"),
        (c("n_rows") >= vocab.LARGE_ROWS).alias("large"),
        (((c("n_numeric") > 0) & (c("n_categorical") > 0)) | (c("n_columns") >= vocab.MANY_COLUMNS)).alias("mixed"),
        ((c("n_categorical") >= vocab.MANY_CATEGORICAL)
         | ((c("n_categorical") >= 3) & (c("n_categorical") > c("n_numeric")))).alias("categorical_heavy"),
        F.coalesce(F.try_divide(c("n_outliers"), c("n_rows") * F.greatest(c("n_numeric"), F.lit(1)))
                   > vocab.OUTLIER_SHARE, F.lit(False)).alias("outliers"),
        F.coalesce(F.try_divide(c("n_missing"), c("n_rows") * F.greatest(c("n_columns"), F.lit(1)))
                   > vocab.MISSING_SHARE, F.lit(False)).alias("missing"),
        (c("skew") > vocab.EXTREME_SKEW).alias("skewed"),
        F.lit(known and ratio < vocab.IMBALANCE_RATIO).alias("imbalanced"),
        F.lit(ratio).cast("double").alias("class_ratio"),
    )


def _finish(scored: DataFrame) -> DataFrame:
    """Rank by score, ties by base order; confidence from the gap to the best."""
    best = F.max("score").over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "base_order"))
    gap = F.col("best") - F.col("score")
    label = F.when(gap <= 0.5, "High").when(gap <= 2.0, "Medium-High").otherwise("Medium")
    reason = capitalised(F.concat_ws("; ", F.slice("parts", 1, 3)))
    reason = F.when(reason.endswith("."), reason).otherwise(F.concat(reason, F.lit(".")))
    return scored.withColumn("best", best).select(
        rank.alias("rank"), F.col("model"), F.col("score"), label.alias("confidence"), reason.alias("reason"))


def rank_supervised(signal_row: DataFrame, problem: str) -> DataFrame:
    """Ranking for classification or regression: rules joined to the active signals, points added up."""
    spark = signal_row.sparkSession
    classify = problem == "classification"
    table = CLASSIFICATION_RULES if classify else REGRESSION_RULES
    order = CLASSIFICATION_ORDER if classify else REGRESSION_ORDER
    rules = small_table(
        spark, [(*r, order.index(r[0])) for r in table],
        "model string, signal string, kind string, points double, position int, reason string, base_order int")
    active = signal_row.select(
        "n_rows", "n_categorical", "class_ratio",
        F.explode(F.array_compact(F.array(
            F.lit("always"), *[F.when(F.col(s), F.lit(s)) for s in SIGNAL_NAMES]))).alias("signal"))
    note = F.concat(
        F.lit("class distribution is imbalanced (minority/majority ratio "),
        F.coalesce(two_places(F.col("class_ratio")), F.lit("")), F.lit(")"))
    text = F.col("reason")
    for mark, value in (
        ("{rows_grouped}", grouped_digits(F.col("n_rows"))), ("{rows}", F.col("n_rows").cast("string")),
        ("{categorical}", F.col("n_categorical").cast("string")), ("{balance}", note),
    ):
        text = F.replace(text, F.lit(mark), value)
    added = F.coalesce(F.sum(F.when(F.col("kind") == "add", F.col("points"))), F.lit(0.0))
    floor = F.max(F.when(F.col("kind") == "floor", F.col("points")))
    scored = (
        active.join(F.broadcast(rules), "signal")
        .withColumn("text", text)
        .groupBy("model", "base_order")
        .agg(
            F.greatest(added, floor).alias("score"),
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("position", "text")))),
                lambda p: p["text"]).alias("parts"))
    )
    return _finish(scored)


def rank_clustering(signal_row: DataFrame) -> DataFrame:
    """KMeans against DBSCAN, by skew and outliers."""
    rough = F.col("skewed") | F.col("outliers")
    detail = F.concat_ws(
        " and ", F.when(F.col("skewed"), F.lit("notable skew across numeric columns")),
        F.when(F.col("outliers"), F.lit("a significant fraction of outlier points")))
    density = F.when(rough, F.concat(
        F.lit("The profile shows "), detail,
        F.lit(", which violates KMeans's assumption of roughly spherical, similarly-sized clusters -- DBSCAN's "
              "density-based approach handles noise and irregular cluster shapes better."))).otherwise(F.lit(
        "A solid alternative if the true cluster structure turns out to be density-based or noisy, but there's no "
        "strong signal for that in this profile."))
    centroid = F.when(rough, F.lit(
        "A reasonable alternative once the data is de-skewed or outliers are handled, but its spherical-cluster "
        "assumption is a weaker fit for this profile as-is.")).otherwise(F.lit(
        "The profile shows no extreme skew or significant outliers, so the roughly spherical, similarly-sized "
        "cluster assumption KMeans relies on is plausible here."))

    def row(model: str, first: Column, reason: Column) -> Column:
        return F.struct(
            F.when(first, 1).otherwise(2).alias("rank"), F.lit(model).alias("model"),
            F.when(first, F.lit(2.0)).otherwise(F.lit(0.0)).alias("score"),
            F.when(first, "High").otherwise("Medium").alias("confidence"), reason.alias("reason"))

    return signal_row.select(F.inline(F.array(row("DBSCAN", rough, density), row("KMeans", ~rough, centroid)))).orderBy("rank")


def rank_models(signal_row: DataFrame, problem: str) -> DataFrame:
    """Ranking for a problem type; empty for an invalid one."""
    if problem in ("classification", "regression"):
        return rank_supervised(signal_row, problem)
    ranked = rank_clustering(signal_row)
    return ranked.where(F.lit(False)) if problem == "invalid" else ranked


def model_warnings(signal_row: DataFrame, problem: str, target: str | None, balance: DataFrame | None = None) -> DataFrame:
    """Non-blocking cautions in order: imbalance, few rows, few features, tiny classes."""
    spark = signal_row.sparkSession
    classes = None
    if problem == "classification" and target and balance is not None:
        classes = balance.where(F.col("column") == target).first()
    smallest, total = (F.lit(classes["minority"]), F.lit(classes["total"])) if classes else (
        F.lit(None).cast("bigint"), F.lit(None).cast("bigint"))
    several = F.lit(bool(classes and classes["classes"] >= 2))
    features = F.col("n_numeric") + F.col("n_categorical")
    texts = F.array_compact(F.array(
        F.when(several & (smallest / total < vocab.MINORITY_SHARE), F.concat(
            F.lit("Target classes are highly imbalanced (minority class: "), small_percent(smallest / total),
            F.lit(" of rows -- "), grouped_digits(smallest), F.lit(" of "), grouped_digits(total),
            F.lit("). Consider class weights, oversampling, or stratified splitting when training."))),
        F.when(F.col("n_rows") < vocab.RELIABLE_ROWS, F.concat(
            F.lit("Only "), F.col("n_rows").cast("string"),
            F.lit(f" rows: this is below the ~{vocab.RELIABLE_ROWS}-row floor for a reliable model, so treat the "
                  "recommendation as indicative rather than definitive."))),
        F.when(features < vocab.RELIABLE_FEATURES, F.concat(
            F.lit("Only "), features.cast("string"),
            F.lit(" usable feature column(s): with so few predictors, model choice matters less than gathering more "
                  "informative features."))),
        F.when(smallest < vocab.ROWS_PER_CLASS, F.concat(
            F.lit("The smallest class has only "), smallest.cast("string"),
            F.lit(f" row(s) (< {vocab.ROWS_PER_CLASS}); a classifier cannot learn it reliably. Consider collecting "
                  "more examples or merging rare classes."))),
    ))
    if problem == "invalid":
        return small_table(spark, [], "ordinal int, warning string")
    return signal_row.select(F.posexplode(texts).alias("pos", "warning")).select(
        (F.col("pos") + 1).alias("ordinal"), "warning")


def model_cards(ranking: DataFrame) -> DataFrame:
    """Ranking joined to the fixed properties of each model family."""
    cards = small_table(
        ranking.sparkSession, vocab.MODEL_FAMILIES,
        "family string, interpretability string, training_speed string, inference_speed string, "
        "handles_missing string, handles_outliers string, scalability string, advantages array<string>, "
        "disadvantages array<string>")
    family = F.regexp_replace("model", " Regressor$", "")
    return ranking.withColumn("family", family).join(F.broadcast(cards), "family", "left").select(
        "rank", "model", "confidence", "reason", "advantages", "disadvantages", "interpretability",
        "training_speed", "inference_speed", "handles_missing", "handles_outliers", "scalability")


def why_not_others(ranking: DataFrame) -> DataFrame:
    """Why each model below the first ranked lower."""
    top = F.first_value("model").over(Window.partitionBy(F.lit(1)).orderBy("rank"))
    text = F.format_string("Ranked below %s (%s confidence): %s", F.col("top"), F.col("confidence"), F.col("reason"))
    return ranking.withColumn("top", top).where("rank > 1").select("rank", "model", text.alias("explanation"))


def readiness_stars(spark, problem: str, warnings: Iterable[str] = ()) -> DataFrame:
    """Star ratings of five uses of the table."""
    thin = any("rows" in w and "below" in w for w in warnings)
    invalid = problem == "invalid"
    stars = (
        ("business_intelligence", 5),
        ("machine_learning", 1 if invalid else 3 if thin else 5),
        ("deep_learning", 2 if thin or problem in ("invalid", "unknown") else 3),
        ("visualization", 5),
        ("deployment", 2 if invalid else 4),
    )
    table = small_table(spark, [(i + 1, d, s) for i, (d, s) in enumerate(stars)], "ordinal int, dimension string, stars int")
    return table.withColumn(
        "display", F.concat(F.repeat(F.lit("★"), F.col("stars")), F.repeat(F.lit("☆"), 5 - F.col("stars"))))
