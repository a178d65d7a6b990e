"""Inputs on which limits, prefixes or overflows used to change a result."""

import math

import numpy as np
import pytest

from plumbline.functions import vocab
from plumbline.operators import charts, correlation, dates, duplicates, facts
from plumbline.operators.columns import columns_of
from plumbline.operators.quantiles import MAX_ROUNDS, column_quantiles
from plumbline.sources import csv_files


def test_sixty_columns_correlate(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(40, 60))], [f"c{i}" for i in range(60)])
    found = facts.column_facts(df, quantiles=False)
    assert correlation.corr_pairs(df, facts=found).count() == correlation.corr_pairs(df).count() == 60 * 59 // 2


@pytest.mark.parametrize("by", [None, "g"])
def test_correlation_of_huge_values(spark, by):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([("s", float(a), float(b * 1e200)) for a, b in zip(x, y)], "g string, x double, y double")
    r = correlation.corr_pairs(df, by=by).first()["r"]
    assert math.isclose(r, np.corrcoef(x, y)[0, 1], abs_tol=1e-9)
    odd = df.unionByName(spark.createDataFrame([("s", 1.0, math.inf)], df.schema))
    assert correlation.corr_pairs(odd, by=by).first()["r"] is None


def test_dates_after_many_other_values(spark):
    rows = [("n/k",)] * 20 + [(f"2020-01-{1 + i % 28:02d}",) for i in range(800)]
    assert [tuple(r) for r in dates.date_formats(spark.createDataFrame(rows, "d string").coalesce(1)).collect()] == [("d", "yyyy-M-d")]
    mixed = [("01/02/2020",)] * 50 + [("2020-01-05",)] * 950
    assert dates.date_formats(spark.createDataFrame(mixed, "d string").coalesce(1)).first()["format"] == "yyyy-M-d"


def test_charts_without_limits(spark):
    df = spark.createDataFrame(
        [(*[f"v{(i * (k + 1)) % 25}" for k in range(12)], *[float(i * i + k) for k in range(17)]) for i in range(100)],
        [f"b{k}" for k in range(12)] + [f"h{k}" for k in range(17)])
    found = facts.column_facts(df)
    bars, specs = charts.bar_data(df, found), charts.histogram_specs(df, found)
    assert bars.select("column").distinct().count() == 12 and specs.count() == 17
    assert charts.bar_data(df, found, vocab.MAX_BARS, vocab.MAX_BAR_CATEGORIES).select("column").distinct().count() <= 10


def test_histogram_of_far_outliers(spark):
    values = [float(v) for v in np.linspace(0, 1, 2000)] + [1e15, -1e15]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    specs = charts.histogram_specs(df, facts.column_facts(df), log_scale=False)
    assert specs.first()["bins"] <= charts.MOST_BINS
    assert charts.histogram_data(df, specs).agg({"n": "sum"}).first()[0] == 2002


@pytest.mark.parametrize("kind", ["log", "infinite", "negative", "constant", "tiny"])
def test_quantiles_of_heavy_tails(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    v = {
        "log": 10 ** rng.uniform(-300, 300, 20000), "infinite": np.r_[np.full(500, np.inf), 1e308 * rng.uniform(0.9, 1.7, 500)],
        "negative": -(10 ** rng.uniform(-5, 5, 5000)), "constant": np.full(900, 7.0),
        "tiny": np.r_[rng.uniform(-5e-320, 5e-320, 2000), np.zeros(10)],
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    import plumbline.operators.quantiles as q

    scans, real = [], q._scan_ranges
    monkeypatch.setattr(q, "_scan_ranges", lambda *a, **k: scans.append(1) or real(*a, **k))
    col = columns_of(df)[0]
    got = column_quantiles(df, [col], (0.0, 0.25, 0.5, 1.0), {col.ordinal: (len(v), float(v.min()), float(v.max()))}, sort_limit=20)
    s = np.sort(v)
    spots = [int(p * (len(v) - 1)) for p in (0.0, 0.25, 0.5, 1.0)]
    for value, at in zip(got[col.ordinal], spots):
        assert s[at] <= value <= s[min(at + 1, len(s) - 1)]
    assert len(scans) <= MAX_ROUNDS + 1


def test_rows_with_maps_are_deduplicated(spark):
    df = spark.sql("SELECT 1 a, map('x', 1, 'y', 2) m UNION ALL SELECT 1, map('y', 2, 'x', 1) UNION ALL SELECT 2, NULL")
    assert duplicates.drop_duplicate_rows(df).count() == 2 == df.count() - duplicates.duplicate_rows(df).first()["duplicates"]


def test_table_without_columns(spark):
    assert facts.basic_facts(spark.createDataFrame([()] * 3, "")).count() == 0


def test_line_breaks_in_cells(spark, put):
    rows = csv_files.read_csv(spark, put('id,text\n1,"a\nb"\n2,c\n')).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "a\nb"), (2, "c")]


def test_rows_like_the_header_stay(spark, put):
    head = ",".join(f"c{i}" for i in range(5))
    body = [",".join([str(k)] * 5) for k in range(40)]
    path = put("\n".join(["a banner", head, *body, head]) + "\n")
    assert csv_files.read_csv(spark, path).count() == 41


def test_decimals_keep_their_digits(spark):
    from plumbline.operators.cleaning import clean

    df = spark.sql("SELECT CAST(v AS decimal(20, 2)) d FROM VALUES ('12345678901234567.89'), (NULL), ('1.25'), ('3.50') t(v)")
    out = clean(df, {"missing_values": {"d": "median"}}).encoded
    assert out.schema == df.schema or dict(out.dtypes)["d"] == "decimal(20,2)"
    assert sorted(str(r["d"]) for r in out.collect()) == ["1.25", "12345678901234567.89", "3.50", "3.50"]


def test_dated_one_hot_columns(spark):
    from plumbline.operators.cleaning import one_hot

    df = spark.sql("SELECT DATE'2020-01-01' d, TIMESTAMP'2020-01-01 00:00:00' t UNION ALL SELECT DATE'2020-01-02', NULL")
    assert one_hot(df, ["d", "t"], ratio=2.0)[0].columns == ["d_2020-01-01", "d_2020-01-02", "t_2020-01-01 00:00:00"]
