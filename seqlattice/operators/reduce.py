"""The best match for each start row, and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import field_type, number, numeric
from ..pattern.model import GREEDY, PLUS, PatternQuery
from .scan import first_key, last_key, order_columns


def preference(df: DataFrame, q: PatternQuery) -> list[tuple[str, bool]]:
    """(path, whether larger is better) in the order in which the pattern's choices are made."""
    out: list[tuple[str, bool]] = []
    for k, v in enumerate(q.variables):
        if k:
            later = q.gaps[k - 1] == GREEDY
            out += [(f"{first_key(q, v.name)}.{c}", later) for c in [q.ts_column, q.id_column]]
        if v.kleene:
            longer = v.quantifier == PLUS
            out += [(f"{last_key(q, v.name)}.{c}", longer) for c in [q.ts_column, q.id_column]]
    return out


def anchor(q: PatternQuery) -> list[str]:
    return list(dict.fromkeys(f"{first_key(q, q.names[0])}.{c}" for c in [*q.partition_by, *order_columns(q), q.id_column]))


def best(df: DataFrame, q: PatternQuery) -> DataFrame:
    """One row for each start row: the candidate the pattern prefers.

    An aggregate where all keys are numbers (partial before the shuffle), a
    window with a group limit otherwise.
    """
    keys = preference(df, q)
    names = list(q.names)
    if not keys:
        return df
    kinds = [field_type(df, *path.split(".")) for path, _ in keys]
    if all(map(numeric, kinds)):
        signed = [number(F.col(p), k) if up else -number(F.col(p), k) for (p, up), k in zip(keys, kinds, strict=True)]
        start = [F.col(a).alias(f"__a{k}") for k, a in enumerate(anchor(q))]
        top = F.max(F.struct(*[s.alias(f"k{k}") for k, s in enumerate(signed)], *[F.col(n) for n in names]))
        return df.groupBy(*start).agg(top.alias("__best")).select(*[F.col(f"__best.{n}").alias(n) for n in names])
    w = Window.partitionBy(*anchor(q)).orderBy(*[F.col(p).desc() if up else F.col(p).asc() for p, up in keys])
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def measure(m, q: PatternQuery) -> Column:
    if m.function == "COUNT":
        return F.col(f"{m.variable}.count").alias(m.alias)
    where = {None: m.variable, "FIRST": f"{m.variable}.first", "LAST": f"{m.variable}.last"}[m.function]
    return F.col(f"{where}.{m.attribute}").alias(m.alias)


def measures(df: DataFrame, q: PatternQuery, keys: bool = False) -> DataFrame:
    """The measures under their aliases; with ``keys``, also each variable's id where no alias clashes."""
    out = [measure(m, q) for m in q.measures]
    taken = {m.alias.lower() for m in q.measures}
    if keys:
        out += [F.col(f"{first_key(q, v)}.{q.id_column}").alias(f"{v}_{q.id_column}") for v in q.names if f"{v}_{q.id_column}".lower() not in taken]
    return df.select(*out)
