"""What cleaning did: before/after comparison, action timeline, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.scalars import signed_difference
from plumbline.session import small_table


def _totals(facts: DataFrame) -> dict:
    return facts.agg(
        F.max("rows").alias("rows"), F.sum("n_null").alias("missing"),
        F.coalesce(F.sum("outliers"), F.lit(0)).alias("outliers"), F.collect_list("column").alias("columns"),
    ).first().asDict()


def before_after(facts_before: DataFrame, facts_after: DataFrame, actions: DataFrame) -> DataFrame:
    """One row comparing the table before and after cleaning.

    Outliers are two independent counts with their own fences. Duplicates
    removed are the rows that de-duplication actually removed.
    """
    spark = facts_before.sparkSession
    before, after = _totals(facts_before), _totals(facts_after)
    log = actions.orderBy("ordinal").collect()
    dropped = [r["column"] for r in log if r["section"] == "dropped_columns"]
    identifiers = [
        r["column"] for r in log if r["section"] == "dropped_columns" and r["reason"] == vocab.IDENTIFIER_REASON]
    encoded = [r["column"] for r in log if r["section"] == "encoding" and r["executed"] == "one_hot"]
    imputed = [r["column"] for r in log if r["section"] == "missing_values" and r["executed"] in ("median", "mode")]
    nulls = {r["column"]: r["n_null"] for r in facts_before.select("column", "n_null").collect()}
    other = [c for c in before["columns"] if c not in after["columns"] and c not in dropped and c not in encoded]
    row = {
        "rows_before": before["rows"], "rows_after": after["rows"],
        "missing_before": before["missing"], "missing_after": after["missing"],
        "outliers_before": before["outliers"], "outliers_after": after["outliers"],
        "duplicates_removed": sum(
            r["rows_removed"] or 0 for r in log if r["section"] == "duplicates" and r["executed"] == "drop"),
        "columns_removed": dropped + other, "columns_encoded": encoded,
        "values_imputed": sum(nulls.get(c, 0) for c in imputed), "identifier_columns_removed": identifiers,
    }
    return small_table(
        spark, [row],
        "rows_before bigint, rows_after bigint, missing_before bigint, missing_after bigint, outliers_before bigint, "
        "outliers_after bigint, duplicates_removed bigint, columns_removed array<string>, "
        "columns_encoded array<string>, values_imputed bigint, identifier_columns_removed array<string>")


def before_after_table(comparison: DataFrame) -> DataFrame:
    """The comparison as seven metric rows with a signed difference."""
    def row(i: int, metric: str, before: Column, after: Column, difference: Column | None = None) -> Column:
        b, a = before.cast("bigint"), after.cast("bigint")
        return F.struct(
            F.lit(i).alias("ordinal"), F.lit(metric).alias("metric"), b.alias("before"), a.alias("after"),
            (signed_difference(b, a) if difference is None else difference).alias("difference"),
            F.lit(metric == "Outliers Detected").alias("informational"))

    def gone(c: Column) -> Column:
        return F.concat(F.lit("-"), c.cast("string"))

    c, zero = F.col, F.lit(0)
    removed, encoded = F.size("columns_removed"), F.size("columns_encoded")
    return comparison.select(F.inline(F.array(
        row(1, "Rows", c("rows_before"), c("rows_after")),
        row(2, "Missing values", c("missing_before"), c("missing_after")),
        row(3, "Outliers Detected", c("outliers_before"), c("outliers_after")),
        row(4, "Duplicate rows removed", c("duplicates_removed"), zero, gone(c("duplicates_removed"))),
        row(5, "Columns removed", removed, zero, gone(removed)),
        row(6, "Columns encoded", encoded, encoded),
        row(7, "Values imputed", c("values_imputed"), zero, gone(c("values_imputed"))),
    )))


_SECTION_ORDER = ("dropped_columns", "missing_values", "duplicates", "outliers", "encoding", "leakage_warnings")


def action_timeline(actions: DataFrame) -> DataFrame:
    """One row per action that ran, in execution order, with reason and confidence."""
    section, column, executed = F.col("section"), F.col("column"), F.col("executed")
    quoted = F.concat(F.lit("'"), column, F.lit("'"))

    def label(action: str) -> Column:
        return F.lit(vocab.ACTION_TEXT[action])

    text = (
        F.when(section == "dropped_columns", F.concat(F.lit("Dropped column "), quoted))
        .when((section == "missing_values") & executed.isin("median", "mode", "drop"), F.concat(
            F.when(executed == "median", label("median")).when(executed == "mode", label("mode"))
            .otherwise(label("drop")), F.lit(" for "), quoted))
        .when((section == "duplicates") & (executed == "drop"), F.lit("Removed duplicate rows"))
        .when((section == "outliers") & executed.isin("cap", "remove"), F.concat(
            F.when(executed == "cap", label("cap")).otherwise(label("remove")), F.lit(" on "), quoted))
        .when((section == "encoding") & (executed == "one_hot"), F.concat(label("one_hot"), F.lit(" "), quoted))
        .when(section == "leakage_warnings", F.concat(F.lit("Flagged possible target leakage in "), quoted))
    )
    named = F.concat(F.lit("Column "), quoted)
    default = (
        F.when(section == "missing_values", F.concat(
            named, F.lit(" had missing values that needed handling before modeling.")))
        .when(section == "duplicates", F.lit(
            "Exact duplicate rows add no new information and can bias model training."))
        .when(section == "outliers", F.concat(
            F.lit("Values in "), quoted, F.lit(" fell outside the IQR fences.")))
        .when(section == "encoding", F.concat(quoted, F.lit(" is categorical; models need numeric input.")))
    )
    order = F.array_position(F.array(*[F.lit(s) for s in _SECTION_ORDER]), section)
    confidence = F.coalesce("confidence", F.lit("Not specified"))
    percent = F.create_map(*[F.lit(x) for kv in vocab.CONFIDENCE_PERCENT.items() for x in kv])
    shown = F.coalesce(
        F.try_element_at(percent, F.lower(confidence)), F.when(confidence.endswith("%"), confidence),
        F.lit("Not specified"))
    return (
        actions.withColumn("action", text).where(F.col("action").isNotNull())
        .select(
            order.alias("stage"), "ordinal", "action", F.coalesce("reason", default).alias("reason"),
            confidence.alias("confidence"), shown.alias("confidence_percent"))
        .orderBy("stage", "ordinal")
    )


def cleaning_summary(actions: DataFrame, comparison: DataFrame) -> DataFrame:
    """One row: rows removed, columns touched, number of planned actions."""
    touched = F.col("section").isin("dropped_columns", "missing_values", "outliers", "encoding")
    counted = touched | ((F.col("section") == "duplicates") & (F.col("executed") == "drop"))
    row = actions.agg(
        F.array_sort(F.collect_set(F.when(touched, F.col("column")))).alias("columns_affected"),
        F.count(F.when(counted, 1)).alias("total_actions"),
    ).first()
    return comparison.select(
        (F.col("rows_before") - F.col("rows_after")).alias("rows_affected"),
        F.array(*[F.lit(c) for c in row["columns_affected"]]).cast("array<string>").alias("columns_affected"),
        F.lit(len(row["columns_affected"])).alias("columns_affected_count"),
        F.lit(row["total_actions"]).cast("bigint").alias("total_actions"))
