"""The query model: variables, gaps, predicates, measures, and its JSON form."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from . import expr

ONE, PLUS, RELUCTANT_PLUS = "ONE", "PLUS", "RELUCTANT_PLUS"
GREEDY, RELUCTANT = "GREEDY", "RELUCTANT"


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    clause: str | None = None
    detail: str | None = None

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}


class QueryError(ValueError):
    """Carries every problem found."""

    def __init__(self, diagnostics: list[Diagnostic]):
        super().__init__("; ".join(f"{d.code}: {d.message}" for d in diagnostics))
        self.diagnostics = diagnostics


@dataclass(frozen=True)
class Variable:
    name: str
    quantifier: str = ONE

    @property
    def kleene(self) -> bool:
        return self.quantifier != ONE


@dataclass(frozen=True)
class Predicate:
    """A conjunct: its text over ``Variable.column`` references, its operator and its variables."""

    text: str
    operator: str
    variables: tuple[str, ...]

    @property
    def node(self) -> expr.Node | None:
        try:
            return expr.parse(self.text)
        except expr.ExpressionError:
            return None

    def columns(self) -> set[tuple[str, str]]:
        return set(expr.references(self.text))


@dataclass(frozen=True)
class Measure:
    variable: str
    attribute: str
    alias: str
    function: str | None = None  # FIRST, LAST, COUNT for Kleene variables
    sql_type: str | None = None

    @property
    def expression(self) -> str:
        ref = f"{self.variable}.{self.attribute}"
        return f"{self.function}({ref})" if self.function else ref


@dataclass(frozen=True)
class PatternQuery:
    variables: tuple[Variable, ...]
    gaps: tuple[str, ...]
    predicates: tuple[Predicate, ...] = ()
    measures: tuple[Measure, ...] = ()
    order_by: tuple[str, ...] = ("ts",)
    partition_by: tuple[str, ...] = ()
    table: str = "events"
    name: str = "query"
    id_column: str = "id"
    ts_column: str = "ts"
    event_schema: tuple[tuple[str, str], ...] = field(default=())
    row_output: str = "ONE ROW PER MATCH"
    after_match: str = "SKIP TO NEXT ROW"

    def __post_init__(self):
        if len(self.gaps) != len(self.variables) - 1:
            raise QueryError([Diagnostic("invalid_pattern_shape", "a gap stands between each two variables")])

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(v.name for v in self.variables)

    @property
    def positions(self) -> dict[str, int]:
        return {v: k for k, v in enumerate(self.names)}

    def variable(self, name: str) -> Variable:
        return next(v for v in self.variables if v.name == name)

    @property
    def kleene(self) -> tuple[str, ...]:
        return tuple(v.name for v in self.variables if v.kleene)

    def independent(self, variable: str) -> list[Predicate]:
        return [p for p in self.predicates if p.variables == (variable,)]

    @property
    def dependent(self) -> list[Predicate]:
        return [p for p in self.predicates if len(p.variables) == 2]

    def carried(self, variable: str) -> list[str]:
        """Columns of a variable that joins and measures need; those of its own filter only are left out."""
        wanted = [c for p in self.dependent for v, c in sorted(p.columns()) if v == variable]
        wanted += [m.attribute for m in self.measures if m.variable == variable and m.function != "COUNT"]
        seen: dict[str, str] = {}
        for c in [self.id_column, self.ts_column, *self.partition_by, *wanted]:
            seen.setdefault(c.lower(), c)
        return list(seen.values())

    # JSON

    def to_dict(self) -> dict:
        dep, own = self.dependent, {v: " AND ".join(p.text for p in self.independent(v)) or "TRUE" for v in self.names}
        return {
            "name": self.name,
            "table": self.table,
            "variables": [{"name": v.name, "quantifier": v.quantifier, "independent_predicate_id": f"ind_{v.name}", "output_prefix": v.name.lower()} for v in self.variables],
            "pattern": {"variables": list(self.names), "wildcard": "Z", "gap_quantifiers": list(self.gaps)},
            "independent_predicates": [{"predicate_id": f"ind_{v}", "kind": "independent", "variables": [v], "sql_template": text} for v, text in own.items()],
            "dependent_predicates": [{"predicate_id": f"dep_{k}", "kind": "dependent", "operator": p.operator, "variables": list(p.variables), "sql_template": p.text} for k, p in enumerate(dep)],
            "measures": [{"expression": m.expression, "alias": m.alias, "sql_type": m.sql_type} for m in self.measures],
            "result_key_columns": [m.alias for m in self.measures if m.attribute == self.id_column],
            "event_schema": [{"name": n, "sql_type": t} for n, t in self.event_schema],
            "id_column": self.id_column,
            "ts_column": self.ts_column,
            "order_by": list(self.order_by),
            "partition_by": list(self.partition_by),
            "row_output": self.row_output,
            "after_match": self.after_match,
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True, indent=1)

    @property
    def fingerprint(self) -> str:
        """sha256 of the canonical JSON form, without the name."""
        d = self.to_dict()
        d.pop("name")
        return hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def to_sql(self) -> str:
        """The query as MATCH_RECOGNIZE text, which the front end reads back to an equal query."""
        mark = {ONE: "", PLUS: "+", RELUCTANT_PLUS: "+?"}
        shape = [self.names[0] + mark[self.variables[0].quantifier]]
        for v, gap in zip(self.variables[1:], self.gaps, strict=True):
            shape += ["Z*" if gap == GREEDY else "Z*?", v.name + mark[v.quantifier]]
        defined: dict[str, list[str]] = {v: [] for v in self.names}
        for p in self.predicates:
            defined[max(p.variables, key=self.positions.__getitem__)].append(p.text)
        partition = f"    PARTITION BY {', '.join(self.partition_by)}\n" if self.partition_by else ""
        measures = ",\n".join(f"        {m.expression} AS {m.alias}" for m in self.measures)
        define = ",\n".join([f"        {v} AS {' AND '.join(t)}" for v, t in defined.items() if t] + ["        Z AS TRUE"])
        return f"SELECT *\nFROM {self.table} MATCH_RECOGNIZE (\n{partition}    ORDER BY {', '.join(self.order_by)}\n    MEASURES\n{measures}\n    ONE ROW PER MATCH\n    AFTER MATCH SKIP TO NEXT ROW\n    PATTERN ({' '.join(shape)})\n    DEFINE\n{define}\n)"

    def with_columns(self, id_column: str, ts_column: str) -> PatternQuery:
        return replace(self, id_column=id_column, ts_column=ts_column)
