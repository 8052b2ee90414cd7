"""Columns as numbers: a common axis for bins, sort keys and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def field_type(df: DataFrame, *path: str) -> T.DataType:
    """The type of a column or of a field within struct columns, names without regard to case."""
    at: T.DataType = df.schema
    for name in path:
        at = next(f.dataType for f in at.fields if f.name.lower() == name.lower())
    return at


def number(c: Column, kind: T.DataType) -> Column:
    """Times as microseconds (long), decimals as doubles, other numbers as they are."""
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * 86_400_000_000
    if isinstance(kind, T.DecimalType):
        return c.cast("double")
    return c


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (*TIMES, T.NumericType))
