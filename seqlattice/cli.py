"""``python -m seqlattice``: read a query, show what the planner makes of it, or run it.

  --sql-file F | --sql-text T | --json F      the query
  --emit query|json|sql|graph|views|strategies|plan|variants|ledger|joins|trace|duckdb|explain
  --run --events PATH [--out PATH]            the answer, shown or written as Parquet
  --run --incremental DIR --batches N         the answer from views kept over batches
  --experiment CONFIG --folder DIR            data, plan, batches and checks from a configuration (see runner.py)
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .pattern.frontend import load, parse_sql
from .pattern.graph import Graph
from .pattern.model import PatternQuery, QueryError


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="seqlattice", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--sql-file")
    source.add_argument("--sql-text")
    source.add_argument("--json", help="a query specification or a dependency graph")
    source.add_argument("--experiment", metavar="CONFIG")
    p.add_argument("--folder", help="where an experiment keeps its data and state")
    p.add_argument("--emit", choices=["query", "json", "sql", "graph", "views", "strategies", "plan", "variants", "ledger", "joins", "trace", "duckdb", "explain"], default="query")
    p.add_argument("--strategy-mode", choices=["full_subsets", "dependency_restricted"], default="full_subsets")
    p.add_argument("--max-strategies", type=int, default=200)
    p.add_argument("--id-column", default="id")
    p.add_argument("--ts-column", default="ts")
    p.add_argument("--run", action="store_true")
    p.add_argument("--events", help="Parquet path of the event table")
    p.add_argument("--out")
    p.add_argument("--cover", help="views to compose from, as A_B,B_C; 'auto' lets the planner choose")
    p.add_argument("--selector", choices=["clique_grow", "edge_cover"], default="clique_grow")
    p.add_argument("--max-rows", type=int)
    p.add_argument("--max-bytes", type=int)
    p.add_argument("--incremental", metavar="DIR")
    p.add_argument("--batches", type=int, default=5)
    p.add_argument("--query-batches", default="all")
    p.add_argument("--selectivities", help="JSON to read, or to write if it isn't there")
    p.add_argument("--output-json")
    return p.parse_args(argv)


def read(a: argparse.Namespace) -> PatternQuery:
    q = parse_sql(a.sql_text, a.id_column, a.ts_column) if a.sql_text else load(a.sql_file or a.json)
    return q.with_columns(a.id_column, a.ts_column) if not a.sql_text and (a.id_column, a.ts_column) != ("id", "ts") else q


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("seqlattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def planned(a: argparse.Namespace, q: PatternQuery, events):
    """(workload, plan) from the event table's statistics."""
    from .plans import covers
    from .plans.cost import Workload, split_batches
    from .plans.selectivity import Selectivities, columns_used, estimate
    from .plans.stats import gather
    from .streaming.schedule import queried_batches

    t = gather(events, [*columns_used(q), q.ts_column], enriched=True)
    file = Path(a.selectivities) if a.selectivities else None
    if file and file.exists():
        s = Selectivities.from_dict(json.loads(file.read_text()), t.rows, query=q.fingerprint)
    else:
        s = estimate(q, t)
        if file:
            file.write_text(json.dumps(s.to_dict(t.rows, query=q.fingerprint), indent=1))
    ts = t.column(q.ts_column)
    rate = t.rows / max((ts.high - ts.low) / 1e6, 1e-9) if t.rows > 1 else 1.0
    w = Workload(Graph(q), split_batches(max(t.rows, a.batches), a.batches), s, rate, queried_batches(a.query_batches, a.batches))
    if a.cover and a.cover != "auto":
        chosen = covers.canonical(w, [frozenset(v.split("_")) for v in a.cover.split(",")])
        return w, covers.build(w, chosen, "given", covers.total_cost(w, chosen))
    if a.selector == "edge_cover":
        return w, covers.edge_cover(w, max_rows=a.max_rows)
    return w, covers.clique_grow(w, max_rows=a.max_rows, max_bytes=a.max_bytes)


def emit(a: argparse.Namespace, q: PatternQuery):
    g = Graph(q)
    if a.emit == "sql":
        return q.to_sql()
    if a.emit == "duckdb":
        from .oracle import answer_sql

        return answer_sql(q)
    if a.emit == "graph":
        return g.to_dict()
    if a.emit == "views":
        return [g.label(v) for v in g.views(a.strategy_mode)]
    if a.emit == "strategies":
        return [sorted(map(g.label, s)) for s in g.strategies(a.strategy_mode, a.max_strategies)]
    if a.emit in ("plan", "variants", "ledger", "joins", "trace", "explain"):
        if not a.events:
            raise SystemExit("--events is needed for statistics")
        events = session().read.parquet(a.events)
        w, p = planned(a, q, events)
        from .plans import codec, cost, ledger

        shown = {
            "plan": lambda: codec.to_dict(p, w),
            "variants": lambda: [codec.to_dict(v, w) for v in codec.variants(w, p, a.max_strategies)],
            "ledger": lambda: [vars(x) for x in ledger.ledger(w, p)],
            "joins": lambda: ledger.join_types(w, p),
            "trace": lambda: [t for v in p.updates() for t in cost.trace(w, v, list(p.sources[v]))],
        }
        if a.emit in shown:
            return shown[a.emit]()
        from .operators.compose import from_cover

        return from_cover(events, q, p.cover, p.tree)._jdf.queryExecution().toString()
    return q.to_dict() | ({"fingerprint": q.fingerprint} if a.emit == "query" else {})


def run(a: argparse.Namespace, q: PatternQuery):
    from pyspark.sql import functions as F

    from .operators.compose import direct, from_cover
    from .sources.dataset import with_batches
    from .streaming.engine import Incremental
    from .streaming.schedule import queried_batches

    spark = session()
    events = spark.read.parquet(a.events)
    if a.incremental:
        w, p = planned(a, q, events)
        engine = Incremental(spark, q, p, a.incremental)
        first = events.agg(F.min(q.id_column)).first()[0]
        numbered = with_batches(events, w.batch_sizes, q.id_column, first)
        asked = queried_batches(a.query_batches, a.batches)
        answer = None
        for b in range(1, a.batches + 1):
            engine.process(numbered.where(F.col("batch_id") == b).drop("batch_id"), b)
            if b in asked:
                answer = engine.answer(b)
                print(f"batch {b}: {answer.count()} matches, state rows {engine.state_rows(b)}", file=sys.stderr)
        return answer if answer is not None else engine.answer()
    if a.cover:
        _, p = planned(a, q, events)
        return from_cover(events, q, p.cover, p.tree)
    return direct(events, q)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    if a.experiment:
        from . import runner

        if not a.folder:
            raise SystemExit("--folder is needed for an experiment")
        print(json.dumps(runner.run(session(), runner.load(a.experiment), a.folder), indent=1))
        return 0
    try:
        q = read(a)
    except QueryError as e:
        print(json.dumps({"diagnostics": [d.to_dict() for d in e.diagnostics]}, indent=1), file=sys.stderr)
        return 1
    if a.run:
        out = run(a, q)
        if a.out:
            out.write.mode("overwrite").parquet(a.out)
        else:
            out.show(50, truncate=False)
        return 0
    got = emit(a, q)
    text = got if isinstance(got, str) else json.dumps(got, indent=1)
    if a.output_json:
        Path(a.output_json).write_text(text)
    else:
        print(text)
    return 0
