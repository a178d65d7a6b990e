import pytest
from pyspark.sql import functions as F

import plumbline as pb
from plumbline.operators import compare
from plumbline.plans.cleaning_plan import propose_plan


def log(result):
    return {(r["section"], r["column"]): r["executed"] for r in result.actions.collect()}


def test_target_survives_every_step(spark):
    df = spark.createDataFrame([(i, 40000 + 10 * i, int(i >= 94)) for i in range(100)], "age long, salary long, Target long")
    plan = {"missing_values": {"Target": "drop"}, "outliers": {"Target": "remove"}, "encoding": {"Target": "one_hot"}}
    got = pb.clean(df, plan, "Target", ["Target"])
    assert got.encoded.groupBy("Target").count().orderBy("Target").collect() == [(0, 94), (1, 6)]
    assert set(log(got).values()) == {"skipped - target column is preserved"}


def test_identifiers_go_and_nulls_are_flagged(churners):
    got = pb.clean(churners, {"missing_values": {"salary": "median"}}, "churn", ["Customer_ID"]).encoded
    assert got.columns == ["age", "salary", "city", "churn", "salary_missing"]
    assert got.agg(F.sum("salary_missing"), F.count("salary")).first() == (5, 120)


def test_imputation_leaves_present_cells_alone(churners):
    got = pb.clean(churners, {"missing_values": {"salary": "median", "city": "mode"}}).encoded
    both = got.join(churners.withColumnRenamed("salary", "before"), "Customer_ID")
    assert both.where("before IS NOT NULL AND before <> salary").count() == 0


def test_every_column_is_never_dropped(spark):
    df = spark.createDataFrame([("a", "b")], "id string, name string")
    assert pb.clean(df, {}, None, ["id", "name"]).encoded.columns == ["id", "name"]


def test_integer_median_keeps_or_widens_the_type(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (None, 3), (None, None)], "half int, whole int")
    got = pb.clean(df, {"missing_values": {"half": "median", "whole": "median"}}).encoded
    assert [r["half"] for r in got.orderBy("half").collect()] == [1.0, 1.5, 1.5, 2.0]
    assert got.schema["whole"].dataType.simpleString() == "int"


def test_sparse_column_is_dropped_instead_of_rows(spark):
    df = spark.createDataFrame([("X" if i < 4 else None, 10 + i, i % 2) for i in range(20)], "Cabin string, Fare long, Target long")
    got = pb.clean(df, {"missing_values": {"Cabin": "drop"}}, "Target")
    assert got.encoded.columns == ["Fare", "Target"] and got.encoded.count() == 20
    reason = got.actions.where("section = 'dropped_columns'").first()["reason"]
    assert "removed 80% of all rows (16 of 20)" in reason
    assert [r["action"] for r in compare.action_timeline(got.actions).collect()] == ["Dropped column 'Cabin'"]


def test_nearly_full_column_drops_rows(spark):
    df = spark.createDataFrame([(None if i == 0 else f"n{i}", i) for i in range(20)], "Notes string, Fare long")
    assert pb.clean(df, {"missing_values": {"Notes": "drop"}}).encoded.count() == 19


def test_row_drop_changes_later_medians(spark):
    df = spark.createDataFrame([("k", 1.0)] * 18 + [(None, 100.0), ("k", None)], "a string, b double")
    got = pb.clean(df, {"missing_values": {"a": "drop", "b": "median"}}).encoded
    assert got.count() == 19 and got.agg(F.max("b")).first()[0] == 1.0


def test_duplicates(spark):
    df = spark.createDataFrame([(i % 3, i % 3) for i in range(6)], "a int, y int")
    assert pb.clean(df, {"duplicates": "drop"}).encoded.count() == 3
    assert pb.clean(df, {"duplicates": "keep"}).encoded.count() == 6


def test_few_rows_leave_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(28)] + [(1e6,)], "x double")
    got = pb.clean(df, {"outliers": {"x": "cap"}})
    assert got.encoded.agg(F.max("x")).first()[0] == 1e6 and log(got)["outliers", "x"].startswith("skipped")


def test_cap_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(60)] + [(1e6,), (None,)], "x double")
    got = pb.clean(df, {"outliers": {"x": "cap"}}).encoded
    assert got.where("x IS NULL").count() == 1 and got.agg(F.max("x")).first()[0] < 100


def test_one_hot_and_its_guards(spark):
    df = spark.createDataFrame([(f"t{i}", ("a", "b", None)[i % 3], i % 2) for i in range(200)], "free string, kind string, y int")
    got = pb.clean(df, {"encoding": {"free": "one_hot", "kind": "one_hot"}}, "y")
    assert got.encoded.columns == ["free", "y", "kind_a", "kind_b"]
    assert got.encoded.agg(F.sum("kind_a"), F.sum("kind_b")).first() == (67, 67)
    assert log(got)["encoding", "free"].startswith("skipped") and got.pre_encoding.columns == ["free", "kind", "y"]
    tiny = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    assert pb.clean(tiny, {"encoding": {"k": "one_hot"}}).encoded.columns == ["k"]  # 2 values in 3 rows


def test_leak_is_flagged_and_kept(spark):
    df = spark.createDataFrame([(2.0 * i, float(i * 7 % 11), float(i)) for i in range(120)], "leaky double, noise double, price double")
    got = pb.clean(df, {}, "price")
    assert log(got) == {("leakage_warnings", "leaky"): "flag"} and "leaky" in got.encoded.columns


def test_too_aggressive_plan_raises(spark):
    df = spark.createDataFrame([(None, 1.0)] + [("a", 2.0)] * 19, "a string, b double").where("a IS NULL")
    wide = df.withColumn("a", F.lit(None).cast("string"))
    assert pb.clean(wide, {"missing_values": {"a": "drop"}}).encoded.columns == ["b"]
    with pytest.raises(pb.CleaningError):
        pb.clean(wide.limit(0), {"missing_values": {"a": "mode"}})


def test_malformed_plan_applies_nothing(churners):
    got = pb.clean(churners, {"raw_plan": "sorry"}, "churn", [])
    assert got.encoded.columns == churners.columns and got.actions.count() == 0


def test_proposed_plan_runs(churners):
    facts = pb.column_facts(churners)
    from plumbline.operators.duplicates import duplicate_rows

    plan = propose_plan(facts, duplicate_rows(churners), ["Customer_ID"])
    assert [(r["section"], r["column"], r["action"]) for r in plan.orderBy("ordinal").collect()] == [
        ("missing_values", "salary", "median"), ("duplicates", None, "keep"), ("outliers", "salary", "cap"),
        ("encoding", "city", "one_hot")]
    got = pb.clean(churners, plan, "churn", ["Customer_ID"])
    table = compare.before_after(facts, pb.column_facts(got.encoded), got.actions)
    row = table.first()
    assert (row["missing_after"], row["values_imputed"], row["columns_encoded"]) == (0, 5, ["city"])
    assert row["columns_removed"] == ["Customer_ID"] and row["outliers_after"] == 0


def test_analyze_end_to_end(churners, tmp_path):
    got = pb.analyze(churners, "churners", cleaned_path=str(tmp_path / "cleaned"))
    assert got.target == "churn" and got.valid and got.problem_type == "classification"
    report = {r["item"]: r["value"] for r in got.report().collect()}
    assert report["rows"] == "120" and report["missing_after"] == "0"
    got.write(str(tmp_path / "results"))
    assert (tmp_path / "results" / "ranking").is_dir()


def test_analyze_stops_on_an_invalid_table(spark):
    df = spark.createDataFrame([(i % 7, 1) for i in range(60)], "a int, Target int")
    got = pb.analyze(df)
    assert not got.valid and got.cleaned is None and "ranking" not in got.tables


def test_rows_are_counted_while_they_are_written(spark):
    from plumbline.session import settled

    rows = spark.createDataFrame([(i % 7, None if i % 3 else "x") for i in range(100)], "a int, b string").repartition(4)
    for df, n in ((rows.dropDuplicates(), 14), (rows.limit(0), 0), (rows.where("a > 99").dropDuplicates(), 0),
                  (rows.selectExpr("a", "b AS A_", "null AS nothing"), 100)):
        kept, counted = settled(df)
        assert kept.count() == counted == n and kept.columns == df.columns
