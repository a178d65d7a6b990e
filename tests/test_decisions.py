import pytest

import plumbline as pb
from plumbline.operators import duplicates, frequency, quality, recommend, roles
from plumbline.plans.cleaning_plan import plan_steps


def choose(df):
    facts = pb.column_facts(df)
    row = roles.target_choice(facts).first()
    ids = [r["column"] for r in roles.identifier_columns(facts, row["target"]).orderBy("ordinal").collect()]
    return facts, row["target"], ids


def validity(df):
    facts, target, ids = choose(df)
    return quality.validity_report(facts, duplicates.duplicate_rows(df), target, ids).first()


def test_named_target_and_identifier(churners):
    facts, target, ids = choose(churners)
    assert (target, ids) == ("churn", ["Customer_ID"])
    assert roles.problem_type(facts, target).first()["problem_type"] == "classification"


def test_continuous_target(spark):
    df = spark.createDataFrame(
        [(500.0 + 10 * i, float(1 + i % 5), 100000 + 1234.5 * i) for i in range(150)], "sqft double, bedrooms double, price double")
    facts, target, ids = choose(df)
    assert (target, ids) == ("price", [])
    assert roles.problem_type(facts, target).first()["problem_type"] == "regression"


def test_salary_beats_ids_and_names(spark):
    df = spark.createDataFrame(
        [(1001 + i, f"Person {i}", 20 + i % 40, ("HR", "IT", "Ops")[i % 3], 30000.5 + 137.7 * ((i * 37) % 120)) for i in range(120)],
        "EmployeeID long, Name string, Age long, Department string, Salary double")
    _, target, ids = choose(df)
    assert (target, ids) == ("Salary", ["EmployeeID", "Name"])


def test_single_column_has_no_target(spark):
    df = spark.createDataFrame([(1,), (2,)], "target int")
    assert choose(df)[1] is None


def test_constant_named_target_is_kept_and_rejected(spark):
    df = spark.createDataFrame([(i % 7, i % 5, 1) for i in range(60)], "a int, b int, Target int")
    got = validity(df)
    assert not got["valid"] and "only 1 unique value(s) in 60" in got["errors"][0]


def test_no_features_left(spark):
    df = spark.createDataFrame([(f"C{i}", i % 2) for i in range(20)], "Customer_ID string, y int")
    got = validity(df)
    assert not got["valid"] and got["errors"][0].startswith("No usable feature columns remain")


def test_many_duplicates_warn_only(spark):
    df = spark.createDataFrame([(1, 2)] * 30 + [(5, 6), (7, 9)], "a int, b int")
    got = validity(df)
    assert got["valid"] and got["duplicate_percentage"] == 90.63 and "90.6% of rows (29)" in got["warnings"][0]


def test_empty_table_is_invalid(spark):
    assert "The uploaded file has no data rows." in validity(spark.createDataFrame([], "a int, b string"))["errors"]


def test_quality_score_of_a_clean_table(spark):
    df = spark.createDataFrame([(float(i), ("a", "b")[i % 2]) for i in range(50)], "x double, label string")
    facts = pb.column_facts(df)
    score = quality.quality_score(
        facts, duplicates.duplicate_rows(df), "label", "classification", [], frequency.class_balance(df, ["label"])).first()
    assert score["quality_score"] == 100 and score["issues"] == []


def rank(spark, problem="classification", **over):
    base = {
        "n_rows": 1000, "n_columns": 8, "n_numeric": 4, "n_categorical": 0, "n_outliers": 0, "n_missing": 0, "small": False,
        "large": False, "mixed": False, "categorical_heavy": False, "outliers": False, "missing": False, "skewed": False,
        "imbalanced": False, "class_ratio": 0.9} | over
    row = spark.createDataFrame([tuple(base.values())], ", ".join(
        f"{k} {'double' if k == 'class_ratio' else 'boolean' if isinstance(v, bool) else 'long'}" for k, v in base.items()))
    return recommend.rank_models(row, problem).orderBy("rank").collect()


def test_ranking_depends_on_the_table(spark):
    assert rank(spark)[0]["model"] == "Gradient Boosting"
    large = rank(spark, n_rows=60000, large=True)
    assert large[0]["model"] == "XGBoost" and "excels on large datasets (60,000 rows)" in large[0]["reason"]
    heavy = rank(spark, categorical_heavy=True, n_categorical=6)
    assert heavy[0]["model"] == "CatBoost" and heavy[0]["score"] == 6.0
    small = rank(spark, small=True, n_rows=100)
    assert [r["model"] for r in small] == ["Gradient Boosting", "Logistic Regression", "Random Forest", "XGBoost"]
    assert small[1]["reason"].startswith("The small dataset (100 rows) makes")


def test_imbalance_note_and_clustering(spark):
    noted = rank(spark, imbalanced=True, class_ratio=0.05)
    assert "class distribution is imbalanced (minority/majority ratio 0.05)" in noted[0]["reason"]
    assert [r["model"] for r in rank(spark, "unknown")] == ["KMeans", "DBSCAN"]
    assert [r["model"] for r in rank(spark, "unknown", skewed=True)] == ["DBSCAN", "KMeans"]
    assert rank(spark, "invalid") == []


def test_cards_use_the_model_family(spark):
    rows = spark.createDataFrame([(1, "XGBoost Regressor", "High", "r"), (2, "Linear Regression", "Medium", "s")],
                                 "rank int, model string, confidence string, reason string")
    cards = {r["model"]: r for r in recommend.model_cards(rows).collect()}
    assert cards["XGBoost Regressor"]["handles_missing"] == "Yes (native)"
    assert "Highly interpretable coefficients" in cards["Linear Regression"]["advantages"]


def test_plan_forms(spark):
    flat = plan_steps(spark, '{"missing_values": {"a": "median", "b": {"action": "mode", "reason": "x"}}, "duplicates": "drop"}')
    assert [(s.section, s.column, s.action, s.reason) for s in flat] == [
        ("missing_values", "a", "median", None), ("missing_values", "b", "mode", "x"), ("duplicates", None, "drop", None)]
    assert plan_steps(spark, {"raw_plan": "..."}) == [] == plan_steps(spark, "not json")


@pytest.mark.parametrize("problem, warnings, stars", [("invalid", [], 1), ("regression", ["Only 9 rows: this is below"], 3), ("regression", [], 5)])
def test_readiness(spark, problem, warnings, stars):
    got = {r["dimension"]: r["stars"] for r in recommend.readiness_stars(spark, problem, warnings).collect()}
    assert got["machine_learning"] == stars
