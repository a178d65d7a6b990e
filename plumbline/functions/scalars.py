"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become null (result values only)."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def fact(c: Column, places: int = 4) -> Column:
    """Display form of a statistic: null when not finite, else rounded."""
    return F.round(finite_or_null(c.cast("double")), places)


def nan_to_null(c: Column, dtype: T.DataType) -> Column:
    """One notion of "missing": a floating NaN is a null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def name_tokens(c: Column) -> Column:
    """Lower-case word tokens of a column name."""
    return F.filter(F.split(F.lower(F.trim(c)), "[^a-z0-9]+"), lambda t: t != "")


def has_word(tokens: Column, words: Sequence[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def is_number_text(c: Column) -> Column:
    return F.trim(c).try_cast("double").isNotNull()


def is_whole(c: Column) -> Column:
    return F.pmod(c, F.lit(1)) == 0


def whole_percent(share: Column) -> Column:
    return F.format_string("%.0f%%", F.round(share * 100, 0))


def small_percent(share: Column) -> Column:
    """Percent text that never rounds a non-zero share to 0%."""
    pct = share * 100
    power = F.floor(F.log10(pct))
    # Two significant digits below 0.01 %.
    scaled = F.round(pct * F.pow(F.lit(10.0), 1 - power), 0)
    carried = scaled >= 100
    digits = F.when(carried, scaled / 10).otherwise(scaled).cast("int")
    power = F.when(carried, power + 1).otherwise(power)
    plain = F.regexp_replace(
        F.when(power >= -3, F.format_string("%.4f", digits / F.lit(1e4)))
        .otherwise(F.format_string("%.5f", digits / F.lit(1e5))),
        "0+$", "",
    )
    mantissa = F.regexp_replace(F.format_string("%.1f", digits / F.lit(10.0)), r"\.0$", "")
    scientific = F.concat(mantissa, F.format_string("e-%02d", (-power).cast("int")))
    return F.concat(
        F.when(pct >= 1, F.format_string("%.0f", F.round(pct, 0)))
        .when(pct >= 0.1, F.format_string("%.1f", F.round(pct, 1)))
        .when(pct >= 0.01, F.format_string("%.2f", F.round(pct, 2)))
        .when(pct <= 0, F.lit("0"))
        .when(power >= -4, plain)
        .otherwise(scientific),
        F.lit("%"),
    )


def two_places(c: Column) -> Column:
    return F.format_string("%.2f", F.round(c, 2))


def one_place(c: Column) -> Column:
    return F.format_string("%.1f", F.round(c, 1))


def grouped_digits(c: Column) -> Column:
    """1234567 -> 1,234,567"""
    return F.format_string("%,d", c.cast("long"))


def strength_words(r: Column) -> Column:
    """Wording of a correlation coefficient."""
    size = F.when(F.abs(r) > 0.5, "strong").when(F.abs(r) > 0.25, "moderate").otherwise("weak")
    sign = F.when(r > 0, "positive").otherwise("negative")
    return F.when(r.isNull(), F.lit(None).cast("string")).otherwise(F.concat_ws(" ", size, sign))


def signed_difference(before: Column, after: Column) -> Column:
    delta = after - before
    return (
        F.when(delta == 0, "0")
        .when(delta > 0, F.concat(F.lit("+"), delta.cast("string")))
        .otherwise(delta.cast("string"))
    )


def safe_name(c: Column) -> Column:
    """Name usable in a file or chart id."""
    return F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_")


def band(score: Column, bands: Sequence[tuple], field: int = 1) -> Column:
    """Text of the first band whose lower bound the score reaches."""
    out = F.when(score >= bands[0][0], F.lit(bands[0][field]))
    for row in bands[1:-1]:
        out = out.when(score >= row[0], F.lit(row[field]))
    return out.otherwise(F.lit(bands[-1][field]))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.substr(c, F.lit(2)))
