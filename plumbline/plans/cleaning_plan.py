"""Cleaning plans: reading them and proposing one from column facts."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.scalars import one_place
from plumbline.session import small_table

MISSING, DUPLICATES, OUTLIERS, ENCODING = "missing_values", "duplicates", "outliers", "encoding"
PLAN_SCHEMA = "ordinal int, section string, column string, action string, reason string, confidence string"


@dataclass(frozen=True)
class Step:
    section: str
    column: str | None
    action: str | None
    reason: str | None = None
    confidence: str | None = None


def unwrap_entries(raw: DataFrame) -> DataFrame:
    """Plan entries from JSON text: a bare action, or {action, reason, confidence}."""
    parsed = F.from_json("raw", "action string, reason string, confidence string")
    bare = F.when(F.col("raw").startswith('"'), F.regexp_extract("raw", '^"(.*)"$', 1))
    return raw.select(
        "ordinal", "section", "column", F.coalesce(bare, parsed["action"]).alias("action"),
        parsed["reason"].alias("reason"), parsed["confidence"].alias("confidence"))


def plan_table(spark: SparkSession, plan) -> DataFrame:
    """A plan given as JSON text, a dict or a DataFrame, as plan rows in execution order.

    Anything malformed yields no rows, so nothing is applied.
    """
    if isinstance(plan, DataFrame):
        return plan.select(*[c.split(" ")[0] for c in PLAN_SCHEMA.split(", ")])
    if isinstance(plan, str):
        try:
            plan = json.loads(plan)
        except ValueError:
            plan = None
    rows = []
    if isinstance(plan, dict) and "raw_plan" not in plan:
        for section in (MISSING, DUPLICATES, OUTLIERS, ENCODING):
            part = plan.get(section)
            if section == DUPLICATES:
                if part is not None:
                    rows.append((section, None, part))
            elif isinstance(part, dict):
                rows += [(section, column, entry) for column, entry in part.items()]
    raw = small_table(
        spark, [(i, s, c, json.dumps(e)) for i, (s, c, e) in enumerate(rows)],
        "ordinal int, section string, column string, raw string")
    return unwrap_entries(raw)


def plan_steps(spark: SparkSession, plan) -> list[Step]:
    """The plan's steps on the driver; their number is bounded by the columns."""
    return [
        Step(r["section"], r["column"], r["action"], r["reason"], r["confidence"])
        for r in plan_table(spark, plan).orderBy("ordinal").collect()
    ]


def propose_plan(facts: DataFrame, duplicates: DataFrame, identifiers: Iterable[str] = ()) -> DataFrame:
    """A deterministic plan: impute, drop duplicates, cap outliers, encode small categories.

    Identifier columns are left out, as cleaning drops them first.
    """
    ids = list(identifiers)
    kept = facts.where(~F.col("column").isin(ids)) if ids else facts
    numeric, categorical = F.col("role") == "numeric", F.col("role") == "categorical"

    def part(rows: DataFrame, order: int, section: str, action: Column, reason: Column) -> DataFrame:
        return rows.select(
            F.lit(order).alias("o"), F.col("ordinal"), F.lit(section).alias("section"), "column",
            action.alias("action"), reason.alias("reason"), F.lit("high").alias("confidence"))

    pct = one_place(F.col("n_null") / F.col("rows") * 100)
    missing = part(
        kept.where((F.col("n_null") > 0) & (F.col("role") != "unsupported")), 1, MISSING,
        F.when(numeric, "median").otherwise("mode"), F.concat(pct, F.lit("% of values are missing.")))
    repeated = duplicates.select(
        F.lit(2).alias("o"), F.lit(0).alias("ordinal"), F.lit(DUPLICATES).alias("section"),
        F.lit(None).cast("string").alias("column"),
        F.when(F.col("duplicates") > 0, "drop").otherwise("keep").alias("action"),
        F.concat(F.col("duplicates").cast("string"), F.lit(" exact duplicate rows.")).alias("reason"),
        F.lit("high").alias("confidence"))
    outside = part(
        kept.where(numeric & (F.col("outliers") > 0)), 3, OUTLIERS, F.lit("cap"),
        F.concat(F.col("outliers").cast("string"), F.lit(" values fall outside the IQR fences.")))
    small = categorical & (F.col("nunique") <= vocab.MAX_CATEGORIES) & (
        F.col("nunique") <= F.col("rows") * vocab.MAX_ENCODE_RATIO)
    encode = part(
        kept.where(small & (F.col("nunique") > 0)), 4, ENCODING, F.lit("one_hot"),
        F.concat(F.col("nunique").cast("string"), F.lit(" distinct values.")))
    rows = missing.unionByName(repeated).unionByName(outside).unionByName(encode).orderBy("o", "ordinal").collect()
    return small_table(
        facts.sparkSession,
        [(i, r["section"], r["column"], r["action"], r["reason"], r["confidence"]) for i, r in enumerate(rows)],
        PLAN_SCHEMA)
