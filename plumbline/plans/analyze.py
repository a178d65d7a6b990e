"""The whole analysis: profile, roles, validity, plan, cleaning, re-profile, ranking, score, report tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.operators import charts, compare, insights, quality, recommend, roles
from plumbline.operators.cleaning import clean
from plumbline.operators.columns import ref
from plumbline.operators.facts import column_facts, missing_profile, numeric_summary, outlier_summary
from plumbline.operators.frequency import categorical, class_balance, value_frequencies
from plumbline.plans.cleaning_plan import plan_table, propose_plan
from plumbline.plans.profile import Profile, _held, profile
from plumbline.session import shared_dir, small_table
from plumbline.sources.sinks import reread, write_results, write_table


@dataclass
class Analysis:
    """Result tables of one analysis; the cleaning and later ones are missing for an invalid table."""

    name: str
    target: str | None
    identifiers: list[str]
    valid: bool
    before: Profile
    tables: dict[str, DataFrame] = field(default_factory=dict)
    cleaned: DataFrame | None = None
    pre_encoding: DataFrame | None = None
    after: Profile | None = None
    problem_type: str | None = None

    def write(self, path: str) -> None:
        """Every result table as one JSON folder."""
        write_results(self.tables, path)

    def report(self) -> DataFrame:
        """The headline numbers as (item, value) rows in fixed order."""
        items: list[tuple[str, str | None]] = [("dataset", self.name)]
        row = self.before.facts.agg(F.max("rows").alias("r"), F.count(F.lit(1)).alias("c")).first()
        items += [("rows", str(row["r"])), ("columns", str(row["c"])), ("target", self.target),
                  ("identifiers", ", ".join(self.identifiers)), ("valid", str(self.valid).lower())]
        if self.valid:
            score = self.tables["quality"].first()
            top = self.tables["ranking"].orderBy("rank").first()
            compared = self.tables["before_after"].first()
            items += [
                ("problem_type", self.problem_type), ("rows_after", str(compared["rows_after"])),
                ("missing_after", str(compared["missing_after"])),
                ("duplicates_removed", str(compared["duplicates_removed"])),
                ("quality_score", str(score["quality_score"])), ("top_model", top["model"] if top else None)]
        spark = self.before.facts.sparkSession
        return small_table(
            spark, [(i + 1, k, v) for i, (k, v) in enumerate(items)], "ordinal int, item string, value string")


def _facts_before_encoding(plain: DataFrame, encoded: DataFrame, facts: DataFrame, mode: str) -> DataFrame:
    """Facts of the columns before encoding: those still present are reused, only the encoded ones are scanned."""
    gone = [n for n in plain.columns if n not in encoded.columns]
    order = small_table(facts.sparkSession, list(enumerate(plain.columns)), "at int, column string")
    known = facts if not gone else facts.unionByName(column_facts(plain.select(*[ref(n) for n in gone]), mode=mode))
    return _held(known.join(F.broadcast(order), "column").withColumn("ordinal", F.col("at")).select(*facts.columns))


def analyze(
    df: DataFrame,
    name: str = "dataset",
    plan=None,
    target: str | None = None,
    cleaned_path: str | None = None,
    mode: str = "exact",
    signals_on: str = "cleaned",
    max_bar_values: int | None = None,
) -> Analysis:
    """Analyse a table end to end. With ``max_bar_values``, bar charts leave out columns that have more values.

    Target and identifiers are decided on the original table. Without ``plan``
    one is proposed from the profile. The cleaned table is written once (to
    ``cleaned_path``, or below the checkpoint folder) and everything after it
    reads those rows. ``signals_on="pre_encoding"`` ranks models on the columns
    before one-hot encoding.
    """
    spark = df.sparkSession
    before = profile(df, mode)
    choice = _held(roles.target_choice(before.facts))
    target = target if target is not None else choice.first()["target"]
    identifiers = [r["column"] for r in roles.identifier_columns(before.facts, target).orderBy("ordinal").collect()]
    validity = _held(quality.validity_report(before.facts, before.duplicates, target, identifiers))
    out = Analysis(name, target, identifiers, validity.first()["valid"], before)
    out.tables.update({
        "facts": before.facts, "duplicates": before.duplicates, "dates": before.dates,
        "top_values": before.top_values, "correlations": before.pairs,
        "missing": missing_profile(before.facts), "numeric_summary": numeric_summary(before.facts),
        "outliers": outlier_summary(before.facts), "candidates": _held(roles.target_candidates(before.facts)),
        "target": choice, "identifiers": roles.identifier_columns(before.facts, target), "validity": validity,
    })
    if not out.valid:
        return out

    steps = plan_table(spark, plan) if plan is not None else propose_plan(before.facts, before.duplicates, identifiers)
    result = clean(df, steps, target, identifiers)
    path = cleaned_path or f"{shared_dir(spark)}/cleaned-{uuid.uuid4().hex}"
    write_table(result.encoded, path)
    out.cleaned, out.pre_encoding = reread(spark, path, result.encoded), result.pre_encoding
    out.after = profile(out.cleaned, mode)
    facts, duplicates = out.after.facts, out.after.duplicates

    problem = _held(roles.problem_type(facts, target))
    out.problem_type = problem.first()["problem_type"]
    balance = None
    if out.problem_type == "classification":
        balance = _held(class_balance(out.cleaned, [target]))
    chart_facts = _facts_before_encoding(out.pre_encoding, out.cleaned, facts, mode)
    signal_row = _held(recommend.signals(chart_facts if signals_on == "pre_encoding" else facts, target, balance))
    ranking = _held(recommend.rank_models(signal_row, out.problem_type))
    warnings = _held(recommend.model_warnings(signal_row, out.problem_type, target, balance))
    score = _held(quality.quality_score(facts, duplicates, target, out.problem_type, identifiers, balance))
    comparison = compare.before_after(before.facts, facts, result.actions)

    bars = charts.bar_data(out.pre_encoding, chart_facts, max_values=max_bar_values)
    specs = charts.histogram_specs(out.pre_encoding, chart_facts)
    values = value_frequencies(df, categorical(df))
    pairs = _held(charts.continuous_pairs(out.pre_encoding, chart_facts))
    out.tables.update({
        "plan": steps, "actions": result.actions, "cleaned_facts": facts, "before_after": comparison,
        "before_after_table": compare.before_after_table(comparison),
        "timeline": compare.action_timeline(result.actions),
        "cleaning_summary": compare.cleaning_summary(result.actions, comparison),
        "problem": problem, "signals": signal_row, "ranking": ranking, "warnings": warnings,
        "model_cards": recommend.model_cards(ranking), "why_not": recommend.why_not_others(ranking),
        "readiness": recommend.readiness_stars(
            spark, out.problem_type, [r["warning"] for r in warnings.collect()]),
        "quality": score, "quality_components": quality.quality_components(score),
        "quality_bands": quality.quality_bands(score), "quality_issues": quality.issue_cards(score),
        "overview": insights.dataset_overview(
            before.facts, name, score.first()["quality_score"], target, out.problem_type),
        "insights": insights.insight_cards(before.facts, before.pairs, values, target, identifiers),
        "statistics": insights.statistics_table(before.facts, identifiers),
        "bars": bars, "histogram_specs": specs, "histograms": charts.histogram_data(out.pre_encoding, specs),
        "scatter_pairs": charts.scatter_pairs(pairs), "heatmap": charts.heatmap_data(out.pre_encoding, chart_facts, pairs),
        "charts": charts.chart_manifest(chart_facts, bars, specs, pairs),
    })
    return out
