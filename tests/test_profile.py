import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plumbline as pb
from plumbline.functions.scalars import small_percent
from plumbline.operators import charts, correlation, duplicates, facts, frequency, insights
from plumbline.operators.columns import columns_of
from plumbline.operators.dates import date_formats, datetime_profile
from plumbline.operators.quantiles import column_quantiles, sliced_quantiles


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def quantile_inputs():
    rng = random.Random(7)
    hot = [5.0] * 400 + [rng.uniform(0, 10) for _ in range(800)]
    tail = [rng.lognormvariate(0, 4) for _ in range(1000)] + [1e300, -1e300]
    gap = [0.0] * 3 + [1e9, 1e9 + 1, 1e9 + 2]
    few = [1.0, 2.0, 2.0, 3.5]
    ends = [float("inf"), float("-inf"), 1.0, 2.0, 3.0, 4.0, 5.0]
    return {"hot": hot, "tail": tail, "gap": gap, "few": few, "one": [7.25], "ends": ends}


@pytest.mark.parametrize("limit", [2, 50, 10**6])
@pytest.mark.parametrize("case", sorted(quantile_inputs()))
def test_quantiles_match_numpy(spark, case, limit):
    values = quantile_inputs()[case]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    found = column_quantiles(df, columns_of(df), (0.1, 0.25, 0.5, 0.75), {0: (len(values), min(values), max(values))}, limit)
    assert found[0] == pytest.approx(np.quantile(values, [0.1, 0.25, 0.5, 0.75]).tolist(), rel=1e-12, nan_ok=True)


@pytest.mark.parametrize("limit", [5, 10**6])
def test_sliced_quantiles_match_numpy(spark, limit):
    rng = random.Random(3)
    data = {"a": [rng.gauss(0, 1) for _ in range(300)], "b": [1.0] * 50 + [rng.random() for _ in range(20)], "c": [4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    found = sliced_quantiles(df, [columns_of(df)[1]], (0.25, 0.5), facts.basic_facts(df, "k"), "k", limit).collect()
    assert len(found) == 3
    for r in found:
        assert [r["p0"], r["p1"]] == pytest.approx(np.quantile(data[r["slice"]], [0.25, 0.5]).tolist(), rel=1e-12)


def test_facts_treat_nan_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None), (3.0, "a")], "x double, s string")
    got = by_column(pb.column_facts(df))
    assert (got["x"]["n_null"], got["x"]["mean"], got["x"]["nunique"]) == (1, 2.0, 2)
    assert got["s"]["n_null"] == 1
    assert got["x"]["outliers"] is None  # two distinct values: fences mean nothing


def test_all_null_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "x double, s string")
    got = by_column(pb.column_facts(df))
    assert got["x"]["mean"] is None and got["x"]["nunique"] == 0
    none = by_column(pb.column_facts(df.limit(0)))
    assert none["s"]["rows"] == 0 and none["s"]["nunique"] == 0
    assert duplicates.duplicate_rows(df.limit(0)).first().asDict() == {"rows": 0, "duplicates": 0, "distinct_rows": 0}


def test_iqr_outlier_is_found(churners):
    got = by_column(facts.outlier_summary(pb.column_facts(churners)))
    assert got["salary"]["outliers"] == 1
    assert "churn" not in got  # two values


def test_approx_mode_is_close(churners):
    exact, approx = by_column(pb.column_facts(churners)), by_column(pb.column_facts(churners, mode="approx"))
    assert approx["age"]["nunique"] == exact["age"]["nunique"] == 25
    assert abs(approx["age"]["median"] - exact["age"]["median"]) <= 1


def test_duplicates_count_null_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, None), (1, None), (1, 1)], "a int, b int")
    assert duplicates.duplicate_rows(df).first()["duplicates"] == 2


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(7.0, float(i), 2.0 * i) for i in range(40)], "const double, x double, y double")
    pairs = {(r["a"], r["b"]): r["r"] for r in correlation.corr_pairs(df).collect()}
    assert pairs["const", "x"] is None and pairs["x", "y"] == pytest.approx(1.0)
    kept = correlation.corr_pairs(df, facts=pb.column_facts(df)).collect()
    assert [(r["a"], r["b"]) for r in kept] == [("x", "y")]


def test_correlation_uses_pairwise_complete_rows(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 3)) + 1e6
    m[rng.random(m.shape) < 0.3] = np.nan
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double")
    for r in correlation.corr_pairs(df).collect():
        x, y = m[:, r["i"]], m[:, r["j"]]
        both = ~np.isnan(x) & ~np.isnan(y)
        assert r["n"] == both.sum() and r["r"] == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-9)


def test_correlation_cap_keeps_largest_variances(spark):
    df = spark.createDataFrame([tuple(float(i * k) for k in range(1, 6)) for i in range(5)], "a double, b double, c double, d double, e double")
    kept = correlation.correlatable(pb.column_facts(df), cap=2).collect()
    assert sorted(r["column"] for r in kept) == ["d", "e"]


def test_top_values_are_cut_and_counted(spark):
    df = spark.createDataFrame([(f"v{i:03d}",) for i in range(60)] + [("v007",)], "s string")
    top = frequency.top_values(df).orderBy("rk").collect()
    assert len(top) == 50 and top[0]["value"] == "v007" and top[0]["nunique"] == 60 and top[0]["truncated"]
    table = frequency.frequency_tables(df).first()
    assert len(table["frequency_table"]) == 50 and table["frequency_table"]["v007"] == 2


def test_most_imbalanced_column_counts_all_values(spark):
    """wide: 59 values of 10 rows and one of a single row; narrow: 2 values, ratio about a fifth."""
    wide = [f"v{i:02d}" for i in range(59) for _ in range(10)] + ["rare"]
    df = spark.createDataFrame([(w, "a" if i % 6 else "b") for i, w in enumerate(wide)], "wide string, narrow string")
    result = pb.analyze(df, "t")
    cards = {r["title"]: r for r in result.tables["insights"].collect()}
    found = pb.column_facts(df)
    values = frequency.value_frequencies(df, frequency.categorical(df))
    own = {r["title"]: r for r in insights.insight_cards(found, correlation.corr_pairs(df, facts=found), values, None).collect()}
    for got in (cards, own):
        assert got["Most Imbalanced Feature"]["value"] == "wide"
        assert got["Most Imbalanced Feature"]["detail"] == "Minority/majority ratio of 0.10."


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 2, True), ("a", 1, False), ("b", 1, True), ("a", 2, True)], "s string, n int, t boolean")
    assert {r["column"]: r["value"] for r in frequency.mode_values(df).collect()} == {"s": "a", "n": "1", "t": "true"}


def test_dates_are_found_and_other_text_is_not(spark):
    rows = [(f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", f"{1 + i % 12:02d}/15/2021", f"word {i}", "20200115") for i in range(60)]
    df = spark.createDataFrame(rows, "iso string, us string, word string, plain string")
    got = {r["column"]: r for r in datetime_profile(df).collect()}
    assert set(got) == {"iso", "us", "plain"}
    assert (got["iso"]["min_date"], got["iso"]["max_date"], got["iso"]["distinct_months"]) == ("2020-01-01", "2020-03-04", 3)
    assert got["us"]["format"] == "M/d/yyyy" and got["us"]["distinct_days"] == 1


def test_date_share_below_ninety_percent_is_no_date(spark):
    df = spark.createDataFrame([("2020-01-01",)] * 8 + [("unknown",)] * 2, "d string")
    assert date_formats(df).collect() == []


def test_mixed_date_formats_are_read_freely(spark):
    df = spark.createDataFrame([("2020-01-15",), ("Jan 16, 2020",)] * 20, "d string")
    got = datetime_profile(df).first()
    assert (got["format"], got["min_date"], got["max_date"]) == ("free", "2020-01-15", "2020-01-16")


def test_profile_record_has_all_parts(churners):
    got = pb.profile_record(pb.profile(churners))
    assert got["shape"] == {"rows": 120, "columns": 5}
    assert got["missing_values"] == {"salary": 5} and got["missing_value_percentages"] == {"salary": 4.17}
    assert got["categorical_summary"]["city"] == {
        "unique_count": 4, "frequency_table": {"CHI": 30, "LA": 30, "NY": 30, "SF": 30}, "truncated": False}
    assert got["correlations"]["age"]["age"] == 1.0
    assert set(got) == {
        "shape", "columns", "missing_values", "missing_value_percentages", "duplicates", "numeric_summary",
        "categorical_summary", "datetime_columns", "outliers", "correlations"}


def test_small_percent_never_rounds_to_zero(spark):
    shares = [1e-5, 0.5, 0.0999, 0.0055, 5.5e-5, 1.2345e-6, 9.96e-7, 3e-8]
    want = ["0.001%", "50%", "10%", "0.5%", "0.0055%", "0.00012%", "0.0001%", "3e-06%"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(shares)], "i int, x double")
    assert [r["p"] for r in rows.select("i", small_percent(F.col("x")).alias("p")).orderBy("i").collect()] == want


def test_correlation_by_slice_from_small_matrices(spark, monkeypatch):
    """Many slices over several tasks, gaps, a null slice, a slice of one row; with and without early sending."""
    rng = np.random.default_rng(5)
    n = 3000
    slices = [None if k == 37 else f"s{k}" for k in np.minimum(rng.integers(0, 60, n), 37).tolist()]
    x, y, z = rng.normal(1e6, 3, n), rng.normal(0, 1, n), rng.normal(0, 1, n)
    y, z = y + x - 1e6, np.where(rng.random(n) < 0.3, np.nan, z)
    rows = [(s, float(a), float(b), None if np.isnan(c) else float(c)) for s, a, b, c in zip(slices, x, y, z)] + [("lonely", 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double").repartition(5)
    for held in (correlation.HELD_CELLS, 40):
        monkeypatch.setattr(correlation._sliced_gram, "__defaults__", (held,))
        got = {(r["slice"], r["a"], r["b"]): (r["n"], r["r"]) for r in correlation.corr_pairs(df, by="k").collect()}
        for key in set(slices):
            mine = np.array([s == key for s in slices])
            for a, b, p, q in (("x", "y", x, y), ("x", "z", x, z), ("y", "z", y, z)):
                both = mine & ~np.isnan(p) & ~np.isnan(q)
                assert got[key, a, b][0] == both.sum()
                assert got[key, a, b][1] == pytest.approx(np.corrcoef(p[both], q[both])[0, 1], abs=1e-6)
        assert got["lonely", "x", "y"] == (1, None) and ("lonely", "x", "z") not in got


def test_binned_density_is_close(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate((rng.normal(0, 1, 3000), rng.normal(6, 0.5, 1500), [40.0, -3.0, -3.0]))
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(4)
    specs = charts.histogram_specs(df, facts.column_facts(df), log_scale=False)
    exact, binned = ({r["point"]: r["density"] for r in charts.density_curves(df, specs, cells_per_width=c).collect()} for c in (None, 400))
    assert exact.keys() == binned.keys() and max(abs(exact[p] - binned[p]) for p in exact) < 1e-6 * max(exact.values())


def test_sliced_search_sends_ranges_instead_of_moving_cells(spark, monkeypatch):
    """Few groups: cells are not shuffled by group, whatever the planner's threshold; the join by a shuffle gives the same."""
    from plumbline.operators import quantiles

    long = spark.range(900).selectExpr("cast(id % 3 as string) AS slice", "int(id % 2) AS pos", "double(id * 37 % 400) AS v")
    wanted = long.groupBy("slice", "pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("inside"))
    wanted = wanted.select("slice", "pos", F.explode(F.expr("array(3L, 70L)")).alias("k"), "lo", "hi", "inside")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = quantiles.sliced_order_statistics(long, wanted, ["slice", "pos"], sort_limit=20)
        plan = found._jdf.queryExecution().executedPlan().toString()
        want = {(s, p): sorted(r["v"] for r in long.where((F.col("slice") == s) & (F.col("pos") == p)).collect()) for s in "012" for p in (0, 1)}
        got = sorted(tuple(r) for r in found.collect())
        assert "BroadcastHashJoin" in plan and got == sorted((s, p, k, want[s, p][k]) for s, p in want for k in (3, 70))
        monkeypatch.setattr(quantiles, "SENT_RANGES", 0)
        again = quantiles.sliced_order_statistics(long, wanted, ["slice", "pos"], sort_limit=20)
        assert "BroadcastHashJoin" not in again._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in again.collect()) == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
