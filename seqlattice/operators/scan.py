"""Filtered scans: one DataFrame of one struct column for each variable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..pattern.expr import spark_text
from ..pattern.model import PatternQuery, Predicate


def condition(predicates: list[Predicate]) -> Column:
    return reduce(lambda a, b: a & b, [F.expr(spark_text(p.text)) for p in predicates], F.lit(True))


def scan(events: DataFrame, q: PatternQuery, variable: str) -> DataFrame:
    """Rows that can be ``variable``, as a struct column of that name with the columns later steps need."""
    rows = events.alias(variable)
    if own := q.independent(variable):
        rows = rows.where(condition(own))
    return rows.select(F.struct(*[F.col(f"{variable}.{c}").alias(c) for c in q.carried(variable)]).alias(variable))


def first_key(q: PatternQuery, variable: str) -> str:
    """Where a variable's first row stands in its struct."""
    return f"{variable}.first" if q.variable(variable).kleene else variable


def last_key(q: PatternQuery, variable: str) -> str:
    return f"{variable}.last" if q.variable(variable).kleene else variable


def order_columns(q: PatternQuery) -> list[str]:
    """The time column, and the id behind it where the query orders by more than one column."""
    return [q.ts_column] if len(q.order_by) == 1 else [q.ts_column, q.id_column]


def before(q: PatternQuery, a: str, b: str) -> Column:
    """Variable ``a`` ends before ``b`` begins."""
    cols = order_columns(q)
    x, y = last_key(q, a), first_key(q, b)
    if len(cols) == 1:
        return F.col(f"{x}.{cols[0]}") < F.col(f"{y}.{cols[0]}")
    return F.struct(*[F.col(f"{x}.{c}") for c in cols]) < F.struct(*[F.col(f"{y}.{c}") for c in cols])


def same_partition(q: PatternQuery, a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{first_key(q, a)}.{k}") == F.col(f"{first_key(q, b)}.{k}") for k in q.partition_by], F.lit(True))
