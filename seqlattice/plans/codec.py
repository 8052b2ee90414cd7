"""Plans as JSON lines and CSV rows, and back."""

from __future__ import annotations

import csv
import io
import json

from ..pattern.graph import View
from .cost import Workload
from .covers import Plan
from .joinorder import Tree
from .ledger import invalid

FIELDS = ("plan_id", "selector", "cover", "tree", "updates", "total_cost", "feasible")


def view_of(label: str) -> View:
    return frozenset(label.split("_"))


def tree_of(data) -> Tree:
    return view_of(data) if isinstance(data, str) else (tree_of(data[0]), tree_of(data[1]))


def to_dict(plan: Plan, w: Workload) -> dict:
    return {"plan_id": plan.plan_id(w)} | plan.to_dict(w)


def from_dict(data: dict, w: Workload) -> Plan:
    """The plan that :func:`to_dict` described; a ValueError names what doesn't fit the query, or that the id is another plan's."""
    if missing := [f for f in FIELDS if f not in data]:
        raise ValueError(f"no {', '.join(missing)}")
    plan = Plan(tuple(map(view_of, data["cover"])), tree_of(data["tree"]), {view_of(u["view"]): tuple(map(view_of, u["sources"])) for u in data["updates"]}, float(data["total_cost"]), data["selector"], bool(data["feasible"]))
    if found := invalid(w, plan):
        raise ValueError("; ".join(found))
    if plan.plan_id(w) != data["plan_id"]:
        raise ValueError("the id is that of another plan")
    return plan


def to_json_lines(plans: list[Plan], w: Workload) -> str:
    return "".join(json.dumps(to_dict(p, w), sort_keys=True) + "\n" for p in plans)


def from_json_lines(text: str, w: Workload) -> list[Plan]:
    return [from_dict(json.loads(line), w) for line in text.splitlines() if line.strip()]


def to_csv(plans: list[Plan], w: Workload) -> str:
    out = io.StringIO()
    rows = csv.DictWriter(out, FIELDS, lineterminator="\n")
    rows.writeheader()
    for p in plans:
        rows.writerow({k: json.dumps(v) if isinstance(v, list | bool) else v for k, v in to_dict(p, w).items()})
    return out.getvalue()


def from_csv(text: str, w: Workload) -> list[Plan]:
    read = lambda k, v: json.loads(v) if k in ("cover", "updates", "feasible") else json.loads(v) if k == "tree" and v.startswith("[") else v
    return [from_dict({k: read(k, v) for k, v in row.items()}, w) for row in csv.DictReader(io.StringIO(text))]


def variants(w: Workload, plan: Plan, most: int = 16) -> list[Plan]:
    """The plan, and others of the same views that compose in other orders: left-deep ones that go along edges or shared variables, cheapest first."""
    from dataclasses import replace

    from .covers import nodes
    from .joinorder import all_left_deep, leaves, tree_cost

    linked = lambda a, b: bool(a & b) or any(set(e) & a and set(e) & b for e in w.graph.edges)

    def along(tree: Tree) -> bool:
        row = leaves(tree)
        return all(any(linked(a, b) for a in row[:k]) for k, b in enumerate(row) if k)

    views = nodes(w, plan.cover)
    trees = all_left_deep(views) if len(views) <= 7 else ()
    found = sorted((t for t in trees if t != plan.tree and along(t)), key=lambda t: (tree_cost(w, t), tuple(map(w.graph.key, leaves(t)))))
    return [plan, *(replace(plan, tree=t) for t in found[: most - 1])]
