"""The full profile of a table as one nested record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.correlation import corr_pairs, correlation_matrix
from plumbline.operators.dates import datetime_profile
from plumbline.operators.duplicates import duplicate_rows
from plumbline.operators.facts import column_facts, missing_profile, numeric_summary, outlier_summary
from plumbline.operators.frequency import top_values
from plumbline.session import small_table, together


@dataclass(frozen=True)
class Profile:
    """The tables of a profile: one row per column, pair or top value."""

    facts: DataFrame
    duplicates: DataFrame
    dates: DataFrame
    top_values: DataFrame
    pairs: DataFrame


def _held(table: DataFrame) -> DataFrame:
    """Keep a result whose rows are bounded by the columns on the driver."""
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    return small_table(table.sparkSession, [r.asDict() for r in table.collect()], ddl).coalesce(1)


def profile(df: DataFrame, mode: str = "exact") -> Profile:
    """Profile a table; every part is computed once and is small."""
    facts, dates, repeated, top = together(
        lambda: column_facts(df, mode=mode), lambda: _held(datetime_profile(df)), lambda: _held(duplicate_rows(df)),
        lambda: _held(top_values(df)))
    date_columns = [r["column"] for r in dates.select("column").collect()]
    if date_columns:
        facts = facts.withColumn("role", F.when(F.col("column").isin(date_columns), "datetime").otherwise(F.col("role")))
        top = top.where(~F.col("column").isin(date_columns))
    return Profile(facts, repeated, dates, top, _held(corr_pairs(df, facts=facts)))


def profile_record(p: Profile) -> dict:
    """The profile as plain dicts, keyed by column."""
    facts = p.facts.orderBy("ordinal").collect()
    head = facts[0] if facts else None
    dup = p.duplicates.first()
    frequency: dict = {}
    for r in p.top_values.orderBy("column", "rk").collect():
        entry = frequency.setdefault(
            r["column"], {"unique_count": r["nunique"], "frequency_table": {}, "truncated": r["truncated"]})
        entry["frequency_table"][r["value"]] = r["n"]
    for r in facts:
        if r["role"] == "categorical":
            frequency.setdefault(r["column"], {"unique_count": 0, "frequency_table": {}, "truncated": False})
    matrix: dict = {}
    for r in correlation_matrix(p.pairs).collect():
        matrix.setdefault(r["a"], {})[r["b"]] = r["r"]
    missing = missing_profile(p.facts).collect()
    return {
        "shape": {"rows": head["rows"] if head else 0, "columns": len(facts)},
        "columns": {r["column"]: r["dtype"] for r in facts},
        "missing_values": {r["column"]: r["n_null"] for r in missing},
        "missing_value_percentages": {r["column"]: r["null_pct"] for r in missing},
        "duplicates": dup["duplicates"],
        "numeric_summary": {
            r["column"]: {k: r[k] for k in ("mean", "median", "std", "min", "max")}
            for r in numeric_summary(p.facts).collect()},
        "categorical_summary": frequency,
        "datetime_columns": {
            r["column"]: {
                "type": "datetime", "min": r["min_date"], "max": r["max_date"],
                "distinct_years": r["distinct_years"], "distinct_months": r["distinct_months"],
                "distinct_days": r["distinct_days"]}
            for r in p.dates.collect()},
        "outliers": {
            r["column"]: {"count": r["outliers"], "lower_bound": r["lower_bound"], "upper_bound": r["upper_bound"]}
            for r in outlier_summary(p.facts).collect()},
        "correlations": matrix,
    }
