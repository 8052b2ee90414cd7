"""Joins whose condition bounds the difference of two columns: a bin on each side turns them into equi-joins.

For ``lo <= R.x - L.y <= hi`` with constants, both columns are cut into bins of
half the width ``hi - lo``, so that wide windows leave keys enough.  A row of one
side has one bin, one of the other side the three or four that its partners can
lie in, so a pair meets once; the condition itself stays and decides.  Beside an equality the bin also splits hot keys: rows
of one key meet only within the window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import TIMES, field_type, number, numeric
from ..pattern import expr
from ..pattern.model import Predicate


@dataclass(frozen=True)
class Axis:
    """``lo <= later - earlier <= hi`` in numbers (microseconds for times)."""

    later: tuple[str, ...]
    earlier: tuple[str, ...]
    lo: float
    hi: float


def axes(predicates: list[Predicate], extra: list[Axis]) -> list[Axis]:
    """Two-sided bounds that the predicates and what is known besides (windows, order) imply."""
    found: dict[tuple, list[float]] = {}

    def add(later, earlier, lo, hi):
        if (earlier, later) in found:
            later, earlier, lo, hi = earlier, later, None if hi is None else -hi, None if lo is None else -lo
        now = found.setdefault((later, earlier), [-float("inf"), float("inf")])
        now[0], now[1] = max(now[0], -float("inf") if lo is None else lo), min(now[1], float("inf") if hi is None else hi)

    for a in extra:
        add(a.later, a.earlier, a.lo, a.hi)
    for p in predicates:
        for b in expr.bounds(p.node) if p.node else []:
            add(b.later, b.earlier, b.lo, b.hi)
    out = [Axis(later, earlier, lo, hi) for (later, earlier), (lo, hi) in found.items() if lo > -float("inf") and hi < float("inf")]
    return [a for a in out if a.hi > a.lo]


def side(df: DataFrame, path: tuple[str, ...]) -> bool:
    return path[0] in df.columns


def join(left: DataFrame, right: DataFrame, condition: Column, bounds: list[Axis] = (), how: str = "inner") -> DataFrame:
    """Inner join of frames of struct columns; the first bound between the two sides, times before numbers, becomes bins."""
    usable = []
    for a in bounds:
        for a_ in (a, Axis(a.earlier, a.later, -a.hi, -a.lo)):
            if side(left, a_.earlier) and side(right, a_.later):
                kinds = field_type(left, *a_.earlier), field_type(right, *a_.later)
                if all(map(numeric, kinds)) and isinstance(kinds[0], TIMES) == isinstance(kinds[1], TIMES):
                    usable.append((not isinstance(kinds[0], TIMES), a_, kinds))
    if not usable:
        return left.join(right, condition, how)
    _, a, (lk, rk) = min(usable, key=lambda u: u[0])
    y, x = number(F.col(".".join(a.earlier)), lk), number(F.col(".".join(a.later)), rk)
    width = (a.hi - a.lo) / 2
    slack = max(abs(a.hi), abs(a.lo)) * 1e-9
    cell = lambda c: F.floor(c / F.lit(float(width))).cast("long")
    near = F.explode(F.sequence(cell(x - F.lit(a.hi + slack)), cell(x - F.lit(a.lo - slack))))
    met = left.withColumn("__cell", cell(y.cast("double"))).join(right.withColumn("__bin", near), (F.col("__bin") == F.col("__cell")) & condition, how)
    return met.drop("__cell", "__bin")
