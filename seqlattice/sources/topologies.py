"""Queries by shape: which pairs of variables a predicate joins."""

from __future__ import annotations

from ..pattern.model import GREEDY, Measure, PatternQuery, Predicate, Variable


def edges(n: int, shape: str) -> list[tuple[int, int]]:
    chain = [(k, k + 1) for k in range(n - 1)]
    if shape == "diamond" and n != 4:
        raise ValueError("a diamond has four variables")
    shapes = {
        "chain": chain,
        "star": [(0, k) for k in range(1, n)],
        "cycle": [*chain, (0, n - 1)] if n > 2 else chain,
        "complete": [(a, b) for a in range(n) for b in range(a + 1, n)],
        "triangle": [*chain, (0, 2)] if n > 2 else chain,
        "diamond": [(0, 1), (0, 2), (0, 3), (1, 2), (2, 3)],
        "long_edge": [(0, n - 1)],
        "independent": [],
    }
    shapes["clique"] = shapes["complete"]
    if shape not in shapes:
        raise ValueError(f"shapes are {', '.join(shapes)}")
    return shapes[shape]


def query(n: int, shape: str, filters: list[str], predicates: str | list[str], gaps: list[str] | None = None, **options) -> PatternQuery:
    """A query of ``n`` variables A, B, ...: ``filters`` hold ``{v}``, ``predicates`` (one, or several in turn) ``{a}`` and ``{b}``."""
    names = [chr(ord("A") + k) for k in range(n)]
    kinds = [predicates] if isinstance(predicates, str) else predicates
    own = [Predicate(f.format(v=v), "=", (v,)) for v, f in zip(names, filters, strict=False)]
    joins = [Predicate(part.format(a=names[a], b=names[b]), "=", (names[a], names[b])) for k, (a, b) in enumerate(edges(n, shape)) for part in kinds[k % len(kinds)].split(" && ")]
    id_column = options.get("id_column", "id")
    measures = [Measure(v, id_column, f"{v.lower()}_id") for v in names]
    return PatternQuery(tuple(map(Variable, names)), tuple(gaps or [GREEDY] * (n - 1)), tuple(own + joins), tuple(measures), name=f"{shape}_{n}", **options)
