"""Schema walk: what each column of a table is, and its value with missing cells as nulls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import nan_to_null

NUMERIC, BOOLEAN, DATETIME, TEXT, UNSUPPORTED = "numeric", "boolean", "datetime", "text", "unsupported"


@dataclass(frozen=True)
class ColumnInfo:
    ordinal: int
    name: str
    kind: str
    dtype: T.DataType

    @property
    def value(self) -> Column:
        return nan_to_null(ref(self.name), self.dtype)

    @property
    def number(self) -> Column:
        return self.value.cast("double")

    @property
    def is_integral(self) -> bool:
        return isinstance(self.dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))

    @property
    def family(self) -> str:
        """Column family for grouped counts: a type its values fit in without loss."""
        if self.is_integral or self.kind == BOOLEAN or self.kind == DATETIME:
            return "bigint"
        if isinstance(self.dtype, (T.FloatType, T.DoubleType)):
            return "double"
        return "string"

    @property
    def family_value(self) -> Column:
        if isinstance(self.dtype, T.DateType):
            return F.unix_date(self.value).cast("bigint")
        if self.kind == DATETIME:
            return F.unix_micros(self.value.cast("timestamp"))
        if self.kind == BOOLEAN:
            return self.value.cast("int").cast("bigint")
        return self.value.cast(self.family)


def ref(name: str) -> Column:
    """Column by its literal name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    return UNSUPPORTED


def columns_of(df: DataFrame, skip: str | None = None) -> list[ColumnInfo]:
    """Columns in order; ``skip`` leaves out a slice key without shifting ordinals."""
    return [
        ColumnInfo(i, f.name, kind_of(f.dataType), f.dataType)
        for i, f in enumerate(df.schema.fields)
        if f.name != skip
    ]


def numeric_columns(df: DataFrame, skip: str | None = None) -> list[ColumnInfo]:
    return [c for c in columns_of(df, skip) if c.kind == NUMERIC]


def slice_key(by: str | None) -> list[Column]:
    return [ref(by).cast("string").alias("slice")] if by else []
