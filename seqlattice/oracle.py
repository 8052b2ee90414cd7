"""A query as plain SQL for DuckDB: joins and a row number, for cross-checks by another engine."""

from __future__ import annotations

import re

from .pattern.graph import Graph
from .pattern.model import GREEDY, PLUS, PatternQuery


def duck(text: str) -> str:
    """DuckDB counts boundaries in date_diff; date_sub counts whole units, as Spark does."""
    return re.sub(r"\bdate_diff\b|\btimestampdiff\b", "date_sub", text, flags=re.IGNORECASE)


def bare(text: str, v: str) -> str:
    return re.sub(rf"\b{v}\.", "", text)


def own(q: PatternQuery, v: str) -> str:
    return " AND ".join(f"({bare(duck(p.text), v)})" for p in q.independent(v)) or "TRUE"


def runs(q: PatternQuery, v: str, every_end: bool) -> str:
    """(f_<column>, l_<column>, n) of runs: a place for each row, then the first break behind it."""
    part = f"PARTITION BY {', '.join(q.partition_by)} " if q.partition_by else ""
    order = ", ".join([q.ts_column, q.id_column])
    cols = q.carried(v)
    if q.variable(v).quantifier != PLUS:
        return f"SELECT {', '.join(f'{c} AS f_{c}, {c} AS l_{c}' for c in cols)}, 1::BIGINT AS n FROM {q.table} WHERE {own(q, v)}"
    same = "".join(f" AND a.{k} = b.{k}" for k in q.partition_by)
    placed = f"SELECT *, coalesce({own(q, v)}, FALSE) AS fits, row_number() OVER ({part}ORDER BY {order}) AS p FROM {q.table}"
    ended = f"SELECT *, coalesce(min(CASE WHEN NOT fits THEN p END) OVER ({part}ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(p) OVER ({part}) + 1) - 1 AS e FROM ({placed})" if part else f"SELECT *, coalesce(min(CASE WHEN NOT fits THEN p END) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(p) OVER () + 1) - 1 AS e FROM ({placed})"
    end = "b.p BETWEEN a.p AND a.e" if every_end else "b.p = a.e"
    return f"SELECT {', '.join(f'a.{c} AS f_{c}, b.{c} AS l_{c}' for c in cols)}, b.p - a.p + 1 AS n FROM ({ended}) a JOIN ({placed}) b ON {end}{same} WHERE a.fits"


def candidates(q: PatternQuery, variables: list[str] | None = None) -> tuple[str, list[str]]:
    """FROM and WHERE of all candidates of some variables, and the CTEs they need."""
    from .operators.kleene import needs_every_end

    names = variables or list(q.names)
    kleene = set(q.kleene)
    first = lambda v, c: f"{v}.f_{c}" if v in kleene else f"{v}.{c}"
    last = lambda v, c: f"{v}.l_{c}" if v in kleene else f"{v}.{c}"
    ctes = [f"{v} AS ({runs(q, v, needs_every_end(q, v))})" if v in kleene else f"{v} AS (SELECT * FROM {q.table} WHERE {own(q, v)})" for v in names]
    where = [f"({duck(p.text)})" for p in q.dependent if set(p.variables) <= set(names)]
    order = [q.ts_column] if len(q.order_by) == 1 else [q.ts_column, q.id_column]
    for a, b in zip(names, names[1:], strict=False):
        where.append(f"({', '.join(last(a, c) for c in order)}) < ({', '.join(first(b, c) for c in order)})" if len(order) > 1 else f"{last(a, order[0])} < {first(b, order[0])}")
        where += [f"{first(a, k)} = {first(b, k)}" for k in q.partition_by]
    return f"FROM {', '.join(names)} WHERE {' AND '.join(where) or 'TRUE'}", ctes


def view_sql(q: PatternQuery, variables) -> str:
    """All partial matches of a view that the implied windows allow, as ids."""
    names = Graph(q).ordered(variables)
    body, ctes = candidates(q, names)
    for (a, b), w in Graph(q).windows().items():
        if a in names and b in names:
            body += f" AND {b}.{q.ts_column} <= {a}.{q.ts_column} + INTERVAL '{int(w)}' MICROSECOND"
    return f"WITH {', '.join(ctes)} SELECT {', '.join(f'{v}.{q.id_column} AS {v.lower()}_id' for v in names)} {body}"


def answer_sql(q: PatternQuery) -> str:
    """The query's answer."""
    body, ctes = candidates(q)
    kleene = set(q.kleene)
    cell = lambda v, c, end="f": f"{v}.{end}_{c}" if v in kleene else f"{v}.{c}"
    keys = []
    for k, v in enumerate(q.variables):
        if k:
            keys += [f"{cell(v.name, c)} {'DESC' if q.gaps[k - 1] == GREEDY else 'ASC'}" for c in (q.ts_column, q.id_column)]
        if v.kleene:
            keys += [f"{cell(v.name, c, 'l')} {'DESC' if v.quantifier == PLUS else 'ASC'}" for c in (q.ts_column, q.id_column)]
    a = q.names[0]
    anchor = ", ".join(cell(a, c) for c in [*q.partition_by, q.ts_column, q.id_column])
    out = []
    for m in q.measures:
        value = f"{m.variable}.n" if m.function == "COUNT" else cell(m.variable, m.attribute, "l" if m.function == "LAST" else "f")
        out.append(f"{value} AS {m.alias}")
    ranked = f"SELECT {', '.join(out)}, row_number() OVER (PARTITION BY {anchor}{' ORDER BY ' + ', '.join(keys) if keys else ''}) AS rn__ {body}"
    return f"WITH {', '.join(ctes)} SELECT {', '.join(m.alias for m in q.measures)} FROM ({ranked}) WHERE rn__ = 1"
