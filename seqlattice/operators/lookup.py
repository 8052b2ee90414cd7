"""Chains of variables, each tied to the one before: its best row is looked up, pairs are never made.

Where every variable is related to its neighbours alone and all gaps are greedy,
what follows a row does not depend on what comes before it.  From the last
variable back, each row takes the latest row of the next one that fits, with all
that follows that one.  Rows to find and rows that ask meet in groups (equal
keys, bins of time and of a band), in the order of time; a task reads its groups
once.  Per group it keeps the rows that no later one makes useless: the last
row, the last two of different values, or a stack of the last minima.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.axis import TIMES, field_type, number
from ..pattern.expr import MIRROR, Node, Ref, spark_text
from ..pattern.graph import Graph
from ..pattern.model import GREEDY, PatternQuery
from .scan import before, scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

SMALL = (T.ByteType, T.ShortType, T.IntegerType)
EXACT = (*SMALL, T.LongType, T.StringType, *TIMES)
#: Bins of time are so many windows long; a row is in two where the window after it reaches over an end.
WINDOWS = 2
#: A little below the width of the band, so that a band's ends lie in different bins.
BAND = 1 - 1e-6


@dataclass(frozen=True)
class Limit:
    """``column op earlier + plus``; plus is in microseconds beside a time."""

    column: str
    op: str
    earlier: str
    plus: float = 0.0

    @property
    def strict(self) -> bool:
        return self.op in ("<", ">")


@dataclass(frozen=True)
class Step:
    """How a variable's row is found from a row of the variable before."""

    equal: tuple[Limit, ...] = ()
    until: Limit | None = None  # the last time
    low: Limit | None = None  # of one column of numbers
    high: Limit | None = None
    differs: Limit | None = None

    @property
    def band(self) -> float:
        return self.high.plus - self.low.plus if self.low and self.high else 0.0


def limits(node: Node, a: str, b: str) -> list[Limit] | None:
    """A predicate as limits of columns of ``b`` by those of ``a``; None where it is something else."""
    if node.kind == "op" and node.value == "AND":
        both = [limits(x, a, b) for x in node.args]
        return None if None in both else both[0] + both[1]
    if node.kind == "between":
        x, lo, hi = node.args
        return limits(Node("op", "AND", (Node("op", ">=", (x, lo)), Node("op", "<=", (x, hi)))), a, b)
    if node.kind != "op" or node.value not in MIRROR:
        return None
    op, (left, right) = node.value, node.args
    if not (left.kind == "ref" and left.value[0] == b):
        op, left, right = MIRROR[op], right, left
    found = shifted(right)
    if left.kind != "ref" or left.value[0] != b or found is None or found[0][0] != a:
        return None
    return [Limit(left.value[1], op, found[0][1], found[1])]


def shifted(node: Node) -> tuple[Ref, float] | None:
    """(column, constant) of ``column``, ``column + constant`` or ``column - constant``, with one rounding at most."""
    if node.kind == "ref":
        return node.value, 0.0
    if node.kind == "op" and node.value in ("+", "-") and node.args[0].kind == "ref" and node.args[1].kind in ("num", "interval"):
        return node.args[0].value, node.args[1].value if node.value == "+" else -node.args[1].value
    return None


def step(q: PatternQuery, events: DataFrame, a: str, b: str) -> Step | None:
    """The step from one variable to the next, if a lookup can do it."""
    ts, equal, until, low, high, differs = q.ts_column.lower(), [], [], [], [], []
    kind = lambda c: field_type(events, c)
    for p in q.dependent:
        if set(p.variables) != {a, b}:
            continue
        found = limits(p.node, a, b) if p.node else None
        if found is None:
            return None
        for x in found:
            if x.op in ("=", "<>"):
                if x.plus or kind(x.column) != kind(x.earlier) or not isinstance(kind(x.column), EXACT):
                    return None
                (equal if x.op == "=" else differs).append(x)
            elif x.column.lower() == ts:
                if x.earlier.lower() != ts:
                    return None
                if x.op in ("<", "<="):
                    until.append(x)
            elif all(isinstance(kind(c), (T.DoubleType, *SMALL)) for c in (x.column, x.earlier)):
                (high if x.op in ("<", "<=") else low).append(x)
            else:
                return None
    if max(map(len, (until, low, high, differs))) > 1 or differs and (low or high) or any(x.plus <= 0 or x.plus % 1 for x in until):
        return None
    out = Step(tuple(equal), *[x[0] if x else None for x in (until, low, high, differs)])
    if out.low and out.high and (out.low.column.lower() != out.high.column.lower() or out.low.earlier.lower() != out.high.earlier.lower() or out.band <= 0):
        return None
    return out if equal or until or out.band else None


def steps(q: PatternQuery, events: DataFrame) -> list[Step] | None:
    """The steps of a chain that has one without equality at least: joins would make pairs that grow with the square of the rows."""
    if len(q.names) < 2 or q.kleene or q.partition_by or any(g != GREEDY for g in q.gaps) or not isinstance(field_type(events, q.ts_column), (T.TimestampType, T.TimestampNTZType, T.LongType)):
        return None
    pairs = list(zip(q.names, q.names[1:], strict=False))
    if any(e not in pairs for e in Graph(q).edges):
        return None
    out = [step(q, events, a, b) for a, b in pairs]
    return None if None in out or all(s.equal for s in out) else out


def sortable(values):
    """Doubles as integers of the same order, as Spark has it: NaN is the largest, zeros are equal."""
    import numpy as np

    x = np.asarray(values, np.float64) + 0.0
    x = np.where(np.isnan(x), np.nan, x)
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).tolist()


def latest(new: list[bool], asks: list[bool]) -> list[int]:
    """For each row that asks the last one to find before it in its group; -1: none."""
    out, last = [], -1
    for i, (first, ask) in enumerate(zip(new, asks, strict=True)):
        if first:
            last = -1
        if ask:
            out.append(last)
        else:
            last = i
    return out


def latest_other(new: list[bool], asks: list[bool], values: list) -> list[int]:
    """The last row whose value differs from that of the row that asks."""
    out, one, two = [], -1, -1
    for i, (first, ask, x) in enumerate(zip(new, asks, values, strict=True)):
        if first:
            one = two = -1
        if ask:
            out.append(two if one >= 0 and values[one] == x else one)
        else:
            if one >= 0 and values[one] != x:
                two = one
            one = i
    return out


def latest_within(new: list[bool], asks: list[bool], values: list[int], lows: list[int], highs: list[int], modes: list[int], low_strict: bool, high_strict: bool) -> list[int]:
    """The last row of at least a low value (mode 1), at most a high one (2), or both (3, searched row by row: bands without a width to speak of)."""
    out: list[int] = []
    below, below_at, above, above_at, held = [], [], [], [], []
    cut_low, cut_high = bisect_left if low_strict else bisect_right, bisect_left if high_strict else bisect_right
    for i, (first, ask) in enumerate(zip(new, asks, strict=True)):
        if first:
            below, below_at, above, above_at, held = [], [], [], [], []
        if not ask:
            v = values[i]
            while below and below[-1] >= v:
                below.pop()
                below_at.pop()
            below.append(v)
            below_at.append(i)
            while above and above[-1] >= -v:
                above.pop()
                above_at.pop()
            above.append(-v)
            above_at.append(i)
            held.append(i)
        elif modes[i] == 0:
            out.append(held[-1] if held else -1)
        elif modes[i] == 1:
            k = cut_low(above, -lows[i])
            out.append(above_at[k - 1] if k else -1)
        elif modes[i] == 2:
            k = cut_high(below, highs[i])
            out.append(below_at[k - 1] if k else -1)
        else:
            lo, hi = lows[i] + low_strict, highs[i] - high_strict
            out.append(next((k for k in reversed(held) if lo <= values[k] <= hi), -1))
    return out


def finder(keys: list[str], kind: str, low_strict: bool, high_strict: bool):
    """Arrow batches sorted by group and time to pairs of (row that asks, row found)."""

    def pairs(whole):
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = whole.combine_chunks()
        n, column = whole.num_rows, lambda c: pc.fill_null(whole[c], 0).to_numpy()
        changed = [False] * (n - 1)
        for k in keys:
            c = whole[k]
            changed = pc.or_(pa.array(changed), pc.not_equal(c[1:], c[:-1]).combine_chunks()) if n > 1 else []
        new, asks = [True, *(changed.to_pylist() if n > 1 else [])], pc.not_equal(whole["__side"], 0).to_pylist()
        if kind == "any":
            at = latest(new, asks)
        elif kind == "differs":
            at = latest_other(new, asks, whole["__x"].to_pylist())
        else:
            at = latest_within(new, asks, sortable(column("__x")), sortable(column("__low")), sortable(column("__high")), whole["__mode"].to_pylist(), low_strict, high_strict)
        from_ = [i for i, ask in enumerate(asks) if ask]
        met = [(i, j) for i, j in zip(from_, at, strict=True) if j >= 0]
        rows = [whole["__f"].take(pa.array([m[0] for m in met], pa.int64())), whole["__v"].take(pa.array([m[1] for m in met], pa.int64()))]
        return pa.table(rows, ["__f", "__v"]).to_batches(10_000)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held = []
        for b in batches:
            if not b.num_rows:
                continue
            cut = 0
            for k in keys:
                c = b.column(k)
                at = pc.indices_nonzero(pc.not_equal(c[1:], c[:-1]))
                cut = max(cut, at[-1].as_py() + 1 if len(at) else 0)
            if cut:
                yield from pairs(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))


def attach(q: PatternQuery, s: Step, a: str, frame: DataFrame, b: str, rows: DataFrame) -> DataFrame:
    """Each row of ``frame`` (``a``) with the latest of ``rows`` (``b`` and what follows it) that fits; twice where a band lies in two bins."""
    ts = q.ts_column
    kind = field_type(frame, a, ts)
    time = lambda v: number(F.col(f"{v}.{ts}"), kind)
    double = lambda v, c: F.col(f"{v}.{c}").cast("double")
    bound = s.low or s.high
    what = "within" if bound else "differs" if s.differs else "any"
    ask = {f"__k{i}": F.col(f"{a}.{x.earlier}") for i, x in enumerate(s.equal)}
    find = {f"__k{i}": F.col(f"{b}.{x.column}") for i, x in enumerate(s.equal)}
    ask["__t"] = time(a) + F.lit(int(s.until.plus)) if s.until else F.lit(2**63 - 1)
    find["__t"] = time(b)
    ask["__side"], find["__side"] = F.lit(-1 if s.until and s.until.strict else 1), F.lit(0)
    if bound:
        ask |= {"__x": F.lit(None).cast("double"), "__low": double(a, s.low.earlier) + F.lit(s.low.plus) if s.low else F.lit(0.0), "__high": double(a, s.high.earlier) + F.lit(s.high.plus) if s.high else F.lit(0.0)}
        find |= {"__x": double(b, bound.column), "__low": F.lit(None).cast("double"), "__high": F.lit(None).cast("double")}
    elif s.differs:
        ask["__x"], find["__x"] = F.col(f"{a}.{s.differs.earlier}"), F.col(f"{b}.{s.differs.column}")
    asked = frame.select(F.struct(*frame.columns).alias("__f"), *[c.alias(k) for k, c in ask.items()])
    found = rows.select(F.struct(*rows.columns).alias("__v"), *[c.alias(k) for k, c in find.items()])
    asked = asked.where(all_of([F.col(c).isNotNull() for c in asked.columns if c != "__x" or s.differs]))
    found = found.where(all_of([F.col(c).isNotNull() for c in found.columns if c not in ("__low", "__high")]))
    keys = [f"__k{i}" for i in range(len(s.equal))]
    if s.until:
        cell = lambda c: F.floor(c / F.lit(float(WINDOWS * s.until.plus))).cast("long")
        asked = asked.withColumn("__bin", cell(F.col("__t")))
        found = found.withColumn("__bin", F.explode(F.sequence(cell(F.col("__t")), cell(F.col("__t") + F.lit(int(s.until.plus))))))
        keys.append("__bin")
    if s.band:
        place = lambda c: F.floor(c / F.lit(s.band * BAND)).cast("long")
        asked = asked.withColumn("__band", F.explode(F.sequence(place(F.col("__low")), place(F.col("__high")))))
        found = found.withColumn("__band", place(F.col("__x")))
        keys.append("__band")
    if bound:
        mode = F.lit(1 if s.low else 2)
        if s.band:
            mode = F.when(F.col("__band") == place(F.col("__low")), 1).otherwise(0) + F.when(F.col("__band") == place(F.col("__high")), 2).otherwise(0)
        asked, found = asked.withColumn("__mode", mode), found.withColumn("__mode", F.lit(0))
    both = asked.withColumn("__v", F.lit(None).cast(found.schema["__v"].dataType)).unionByName(found.withColumn("__f", F.lit(None).cast(asked.schema["__f"].dataType)))
    # Rows of one time and id are decided by what follows them.
    ties = [F.col(f"__v.{v}.{c}") for v in rows.columns for c in (ts, q.id_column)]
    both = both.repartition(*keys).sortWithinPartitions(*keys, "__t", "__side", *ties)
    fields = [T.StructField(c, both.schema[c].dataType) for c in ("__f", "__v")]
    out = both.mapInArrow(finder(keys, what, bool(s.low and s.low.strict), bool(s.high and s.high.strict)), T.StructType(fields)).select("__f.*", "__v.*")
    return out.where(all_of([F.expr(spark_text(p.text)) for p in q.dependent if set(p.variables) == {a, b}]) & before(q, a, b))


def chain(events: DataFrame, q: PatternQuery, found: list[Step]) -> DataFrame:
    """The best match for each start row, a few times at most."""
    names = list(q.names)
    out = scan(events, q, names[-1])
    for a, b, s in reversed(list(zip(names, names[1:], found, strict=False))):
        out = attach(q, s, a, scan(events, q, a), b, out)
    return out
