"""Matches as joins of scans or views.

A match is one row of each variable such that each comes before the next and
all predicates hold.  Any order of joins gives the same candidates, from frames
that hold any sets of variables, as long as each variable is covered; variables
that two frames share are joined on their rows' ids and times.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axis import field_type, number
from ..pattern import expr
from ..pattern.expr import spark_text
from ..pattern.graph import Graph, View
from ..pattern.model import PatternQuery
from . import kleene, lookup, nearest, rangejoin
from .reduce import best, measures
from .scan import before, first_key, last_key, order_columns, same_partition, scan

Tree = View | tuple  # a view, or (tree, tree)


def source(events: DataFrame, q: PatternQuery, variable: str) -> DataFrame:
    """The rows, or runs, that can be a variable."""
    if q.variable(variable).kleene:
        return kleene.runs(events, q, variable, kleene.needs_every_end(q, variable))
    return scan(events, q, variable)


def covered(tree: Tree) -> View:
    return tree if isinstance(tree, frozenset) else covered(tree[0]) | covered(tree[1])


def implied_equalities(q: PatternQuery, left: DataFrame, lv: View, right: DataFrame, rv: View) -> list[tuple[str, str]]:
    """Columns that must be equal in a match because of variables that neither frame has, where no predicate says so of the two."""
    g, out = Graph(q), []
    for c, sets in g.equal_columns().items():
        for s in sets:
            a, b = ([(v, n) for v in g.ordered(s & x) for n in q.carried(v) if n.lower() == c] for x in (lv, rv))
            said = any((p := expr.equality(n)) and p[0][1].lower() == p[1][1].lower() == c and {p[0][0], p[1][0]} <= s and len({p[0][0], p[1][0]} & lv) == len({p[0][0], p[1][0]} & rv) == 1 for d in q.dependent if d.node for n in expr.conjuncts(d.node))
            if a and b and not said and not s & lv & rv:
                out.append((".".join(a[0]), ".".join(b[0])))
    return out


def join_frames(left: DataFrame, lv: View, right: DataFrame, rv: View, q: PatternQuery, implied: bool = True) -> DataFrame:
    """Join two frames on shared variables, the order of neighbours and all predicates that span the two; with ``implied``, on equalities too that only whole matches must fulfil."""
    g, both = Graph(q), lv | rv
    shared = lv & rv
    for v in shared:
        right = right.withColumnRenamed(v, f"__r_{v}")
    conditions = []
    for v in shared:
        for part in [".first", ".last"] if q.variable(v).kleene else [""]:
            conditions += [F.col(f"{v}{part}.{c}") == F.col(f"__r_{v}{part}.{c}") for c in (q.id_column, q.ts_column)]
    known = [set(lv), set(rv)]
    spans = lambda names: set(names) <= both and not any(set(names) <= k for k in known)
    preds = [p for p in q.dependent if spans(p.variables)]
    conditions += [F.expr(spark_text(p.text)) for p in preds]
    if implied:
        conditions += [F.col(x) == F.col(y) for x, y in implied_equalities(q, left, lv, right, rv)]
    row = g.ordered(both)
    pairs = [(a, b) for a, b in zip(row, row[1:], strict=False) if spans((a, b))]
    conditions += [before(q, a, b) for a, b in pairs]
    if q.partition_by and not shared:
        conditions.append(same_partition(q, g.ordered(lv)[0], g.ordered(rv)[0]))
    windows = g.windows()
    ts = order_columns(q)[0]
    reach = {(a, b): w for (a, b), w in windows.items() if spans((a, b))}
    for (a, b), w in reach.items():  # what follows from the other predicates bounds the frames on both sides
        ends = (last_key(q, a), left if a in lv else right), (first_key(q, b), left if b in lv else right)
        x, y = (number(F.col(f"{key}.{ts}"), field_type(f, *key.split("."), ts)) for key, f in ends)
        conditions.append(y - x <= F.lit(w))
    extra = [rangejoin.Axis((*first_key(q, b).split("."), ts), (*last_key(q, a).split("."), ts), 0.0, w) for (a, b), w in reach.items()]
    bins = [] if shared else rangejoin.axes(preds, extra)
    met = rangejoin.join(left, right, reduce(lambda a, b: a & b, conditions, F.lit(True)), bins)
    return met.drop(*[f"__r_{v}" for v in shared])


def left_deep(order: Sequence[View]) -> Tree:
    return reduce(lambda a, b: (a, b), order)


def build(tree: Tree, frames: dict[View, DataFrame], q: PatternQuery, implied: bool = True) -> DataFrame:
    """The join of a tree of views, from their frames."""
    if isinstance(tree, frozenset):
        return frames[tree]
    a, b = tree
    return join_frames(build(a, frames, q, implied), covered(a), build(b, frames, q, implied), covered(b), q, implied)


def default_tree(q: PatternQuery, views: Sequence[View]) -> Tree:
    """Left-deep from the earliest view on: next the one that shares a variable, then one with an edge, then the earliest."""
    g = Graph(q)
    rest = sorted(views, key=g.key)
    order, have = [rest[0]], set(rest.pop(0))
    while rest:
        edge = lambda v: any(set(e) & have and set(e) & v for e in g.edges)
        nxt = min(rest, key=lambda v: (not v & have, not edge(v), g.key(v)))
        rest.remove(nxt)
        order.append(nxt)
        have |= nxt
    return left_deep(order)


def view(events: DataFrame, q: PatternQuery, variables: View, recent: DataFrame | None = None, implied: bool = False) -> DataFrame:
    """All partial matches of some variables; with ``recent``, those whose last variable is among these newest rows; with ``implied``, only those that equalities by way of other variables allow."""
    g = Graph(q)
    last = g.ordered(variables)[-1]
    singles = [frozenset([v]) for v in variables]
    frames = {s: source(recent if recent is not None and s == frozenset([last]) else events, q, next(iter(s))) for s in singles}
    return build(default_tree(q, singles), frames, q, implied)


def candidates(q: PatternQuery, frames: dict[View, DataFrame], tree: Tree | None = None, cut: Sequence[str] = (), events: DataFrame | None = None) -> DataFrame:
    """All matches, or without a given tree at least the best one for each start row: variables tied by order alone get their nearest row only.

    ``cut``: runs of ``events`` that are not among the frames, to be attached to the rest.
    """
    if tree is not None:
        return build(tree, frames, q)
    free = nearest.free_variables(q, {v for s in frames if len(s) == 1 for v in s})
    alone = {frozenset([v]) for v, _ in free}
    out = build(default_tree(q, [s for s in frames if s not in alone]), frames, q)
    for v, other in free:
        out = nearest.attach(out, q, v, frames[frozenset([v])], other)
    for v in cut:
        out, alone = nearest.attach_cut(out, q, v, events), alone | {frozenset([v])}
    names = list(q.names)
    for a, b in zip(names, names[1:], strict=False):
        if frozenset([a]) in alone or frozenset([b]) in alone:
            out = out.where(before(q, a, b))
    return out


def answer(q: PatternQuery, frames: dict[View, DataFrame], tree: Tree | None = None, keys: bool = False) -> DataFrame:
    """Measures of the best match for each start row, from frames that cover the variables."""
    return measures(best(candidates(q, frames, tree), q), q, keys)


def direct(events: DataFrame, q: PatternQuery, tree: Tree | None = None, keys: bool = False) -> DataFrame:
    """The query's answer from the event table alone."""
    if tree is None and (steps := lookup.steps(q, events)):
        return measures(best(lookup.chain(events, q, steps), q), q, keys)
    cut = nearest.cut_runs(q) if tree is None else []
    frames = {frozenset([v]): source(events, q, v) for v in q.names if v not in cut}
    return measures(best(candidates(q, frames, tree, cut, events), q), q, keys)


def from_cover(events: DataFrame, q: PatternQuery, cover: Sequence[View], tree: Tree | None = None, tables: dict[View, DataFrame] | None = None) -> DataFrame:
    """The answer composed from views; variables that no view holds are scanned."""
    tables = tables or {}
    held = set().union(*cover) if cover else set()
    views = [*cover, *(frozenset([v]) for v in q.names if v not in held)]
    frames = {v: tables[v] if v in tables else view(events, q, v, implied=True) for v in views}
    return answer(q, frames, tree)
