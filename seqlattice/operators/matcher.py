"""A backtracking matcher: the reference semantics, row by row, for tests and as a fallback.

It tries each row as a start and makes the pattern's choices in order: the gap
before a variable (farthest first if greedy), then the length of a run.  A
partition is one group of one task, so it is for partitioned streams of bounded
partitions and for small tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..pattern import expr
from ..pattern.model import GREEDY, PLUS, RELUCTANT_PLUS, PatternQuery
from .scan import condition, order_columns


#: Rows that one task may hold where nothing parts them.
MOST = 200_000


def matches(rows: list[dict], fits: dict[str, list[bool]], q: PatternQuery) -> Iterator[dict[str, tuple[int, int]]]:
    """For each start row with a match: (first, last) row of each variable."""
    n, names = len(rows), q.names
    checks = {v: [(p.node, p.variables) for p in q.dependent if max(p.variables, key=q.positions.__getitem__) == v] for v in names}

    def fit(v: str, i: int, bound: dict) -> bool:
        if not fits[v][i]:
            return False
        row = {u: rows[b[0]] for u, b in bound.items()} | {v: rows[i]}
        return all(expr.evaluate(node, row) is True for node, _ in checks[v])

    def run_from(k: int, i: int, bound: dict) -> dict | None:
        """Variable k starts at row i."""
        v, quantifier = names[k], q.variables[k].quantifier
        if not fit(v, i, bound):
            return None
        ends = [i]
        if quantifier in (PLUS, RELUCTANT_PLUS):
            while ends[-1] + 1 < n and fits[v][ends[-1] + 1]:
                ends.append(ends[-1] + 1)
            if quantifier == PLUS:
                ends.reverse()
        for end in ends:
            now = bound | {v: (i, end)}
            if k + 1 == len(names):
                return now
            later = range(end + 1, n)
            for j in reversed(later) if q.gaps[k] == GREEDY else later:
                if (found := run_from(k + 1, j, now)) is not None:
                    return found
        return None

    for i in range(n):
        if (found := run_from(0, i, {})) is not None:
            yield found


def match_frame(pdf: pd.DataFrame, q: PatternQuery) -> pd.DataFrame:
    """The measures of a partition's matches; columns ``__fit_<variable>`` say which rows can be which."""
    pdf = pdf.sort_values(order_columns(q), kind="stable").reset_index(drop=True)
    rows = [{k: None if pd.isna(x) else x for k, x in r.items()} for r in pdf.to_dict("records")]
    lower = [{k.lower(): x for k, x in r.items()} for r in rows]
    for r, low in zip(rows, lower, strict=True):
        for p in q.predicates:
            for _, c in p.columns():
                r.setdefault(c, low.get(c.lower()))
    out = []
    for m in matches(rows, {v: pdf[f"__fit_{v}"].astype(bool).tolist() for v in q.names}, q):
        row = {}
        for x in q.measures:
            first, last = m[x.variable]
            row[x.alias] = last - first + 1 if x.function == "COUNT" else lower[last if x.function == "LAST" else first][x.attribute.lower()]
        out.append(row)
    return pd.DataFrame(out, columns=[m.alias for m in q.measures])


def match(events: DataFrame, q: PatternQuery) -> DataFrame:
    """The query's answer by the matcher, one group for each partition; refuses tables without partitions above ``MOST`` rows."""
    if not q.partition_by and events.limit(MOST + 1).count() > MOST:
        raise ValueError(f"without PARTITION BY the matcher is one task: more than {MOST} rows")
    names = {f.name.lower(): f for f in events.schema.fields}
    kind = lambda m: "long" if m.function == "COUNT" else names[m.attribute.lower()].dataType.simpleString()
    schema = ", ".join(f"`{m.alias}` {kind(m)}" for m in q.measures)
    flags = []
    for v in q.names:
        own = q.independent(v)
        flags.append((F.coalesce(condition(own), F.lit(False)) if own else F.lit(True), f"__fit_{v}"))
    rows = events
    for c, name in flags:
        variable = name.removeprefix("__fit_")
        rows = rows.alias(variable).select("*", c.alias(name))
    group = list(q.partition_by) or ["__all"]
    rows = rows.withColumn("__all", F.lit(0))
    return rows.groupBy(*group).applyInPandas(lambda pdf: match_frame(pdf, q), schema)
