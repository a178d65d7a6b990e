"""Dates by shape: patterns never refuse what a format reads, bounds are upper bounds, choices equal a full search."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.operators import dates

ODD = ["2020-1-5", "2020-01-05", "02020-1-5", "+12020-01-05", "-2020-01-05", "20200105", "2020010", "020200105", "2020-13-05", "2020-02-30",
       "1/2/2020", "13/2/2020", "2/13/2020", "001/002/2020", "1/2/20", "1-2-2020", "31-12-2020", "5-Jan-2020", "05-JAN-2020", "5-January-2020",
       "Jan 5, 2020", "jan 05, 2020", "Jan 5 2020", "2020-01-05 1:2:3", "2020-01-05 01:02:03", "2020-01-05 24:00:00", "2020-01-05 23:59:60",
       "2020/1/5 0:0:0", "1/2/2020 3:4:5", "13/2/2020 3:4:5", "0/0/2020", "2020-00-00", " 2020-01-05", "2020-01-05 ", "2020-01-05T01:02:03Z",
       "٢٠٢٠-٠١-٠٥", "", "9", "abc", "?", "x" * 200, "2020-01", "2020"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    pieces = ["2020", "99", "1", "01", "12", "13", "31", "32", "-", "/", " ", ":", ", ", "Jan", "Sept", "+", "0"]
    rows = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    rows += ["-".join(p) for p in itertools.product(("2020", "7", "07", "31", "0031"), repeat=3)]
    rows += ["/".join(p) for p in itertools.product(("2020", "7", "07", "31", "0031"), repeat=3)]
    return spark.createDataFrame([(r,) for r in rows] + [(None,)], "v string")


def test_patterns_refuse_nothing_that_a_format_reads(odd):
    v = F.col("v")
    for fmt in vocab.DATE_FORMATS:
        plain = F.try_to_timestamp(v, F.lit(fmt))
        wrong = odd.where(~dates.parse_date(v, fmt).eqNullSafe(plain) | (plain.isNotNull() & ~dates.shape(v).rlike(dates.shape_pattern(fmt))))
        assert wrong.collect() == [], fmt
        assert odd.where(plain.isNotNull()).count() > 0


def test_bounds_hold(odd):
    bounds = {r["format"]: r["most"] for r in dates.format_bounds(odd).collect()}
    n = odd.count() - 1
    for fmt in vocab.DATE_FORMATS:
        assert bounds[fmt] * n + 1e-6 >= odd.where(F.try_to_timestamp("v", F.lit(fmt)).isNotNull()).count()


def test_first_format_in_order_wins(spark):
    days = [f"{1 + i % 12}/{1 + i % 12}/2020" for i in range(100)]  # both month first and day first can read them
    days_first = [f"{1 + i % 28}/{1 + i % 12}/2020" for i in range(100)]
    df = spark.createDataFrame(list(zip(days, days_first, ["soon"] * 100)), "a string, b string, c string")
    assert [tuple(r) for r in dates.date_formats(df).collect()] == [("a", "M/d/yyyy"), ("b", "d/M/yyyy")]


def test_shapes(spark):
    df = spark.createDataFrame([("a1-Bé", 1), ("z9-Cé", 1), (None, 2), ("", 2), ("q" * 101, 3), (" " * 200, 3)], "v string, n long")
    got = {r["shape"]: r["n"] for r in dates.value_shapes(df).collect()}
    assert got == {"a9-aé": 2, "": 1, "(long)": 1, " " * 200: 1}
    assert dates.value_shapes(df.select("n")).count() == dates.date_formats(df.limit(0)).count() == 0
