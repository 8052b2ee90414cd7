"""Experiments from a configuration: data, plan, batches, answers and their check against the events themselves.

A configuration is JSON (or YAML where the library is there) of this form; all
parts but ``query`` have defaults:

    {"data": {"rows": 5000, "profile": "uniform", "types": {"T1": 0.1}, "key_values": 20, "seed": 42},
     "query": {"shape": "chain", "variables": 3, "kind": "equi" | "band", "sigma": 0.05}   or   {"sql": "..."} ,
     "batches": 5, "ask": "all", "selector": "clique_grow" | "edge_cover" | "none",
     "max_rows": null, "max_bytes": null, "firing": {"kind": "always"}, "check": true}

``SEQLATTICE_<KEY>`` in the environment overrides a top-level key that holds a
plain value, as in SEQLATTICE_BATCHES=2.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compose
from .pattern.frontend import parse_sql
from .pattern.graph import Graph
from .pattern.model import PatternQuery
from .plans import codec, covers, ledger
from .plans.cost import Workload
from .plans.selectivity import columns_used, estimate
from .plans.stats import gather
from .plans.storage import file_bytes
from .sources import dataset, generator, topologies
from .streaming.engine import Incremental, identity_gate, result_counts
from .streaming.schedule import Firing, queried_batches

DEFAULTS = {"data": {}, "batches": 5, "ask": "all", "selector": "clique_grow", "max_rows": None, "max_bytes": None, "firing": {"kind": "always"}, "check": True}
KINDS = ("equi", "band")


def load(path: str, env: dict[str, str] | None = None) -> dict:
    """A configuration file with defaults and the environment's switches; a ValueError names all that is wrong."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("no YAML library here: write the configuration as JSON") from missing
        given = yaml.safe_load(text)
    else:
        given = json.loads(text)
    env = dict(os.environ) if env is None else env
    out = DEFAULTS | given
    for k, v in DEFAULTS.items():
        if not isinstance(v, dict) and (value := env.get(f"SEQLATTICE_{k.upper()}")) is not None:
            out[k] = value if isinstance(v, str) else json.loads(value)
    if found := wrong(out):
        raise ValueError("; ".join(found))
    return out


def wrong(c: dict) -> list[str]:
    out = [f"unknown key {k}" for k in c if k not in DEFAULTS | {"query": 0}]
    q = c.get("query") or {}
    if ("sql" in q) == ("shape" in q):
        out.append("a query is given by sql or by shape")
    if "shape" in q:
        try:
            topologies.edges(int(q.get("variables", 3)), q["shape"])
        except ValueError as e:
            out.append(str(e))
        if q.get("kind", "equi") not in KINDS:
            out.append(f"kinds of predicates are {', '.join(KINDS)}")
        if not 0 < float(q.get("sigma", 0.05)) <= 1:
            out.append("sigma is between 0 and 1")
    if not isinstance(c["batches"], int) or c["batches"] < 1:
        out.append("batches is a positive number")
    elif int(c["data"].get("rows", 5000)) < c["batches"]:
        out.append("a batch holds a row at least")
    if c["selector"] not in ("clique_grow", "edge_cover", "none"):
        out.append("selectors are clique_grow, edge_cover and none")
    if c["max_rows"] is not None and c["max_bytes"] is not None:
        out.append("one budget only: rows or bytes")
    if c["data"].get("profile", "uniform") not in generator.PROFILES:
        out.append(f"profiles are {', '.join(generator.PROFILES)}")
    try:
        Firing(**c["firing"])
    except (TypeError, ValueError) as e:
        out.append(str(e))
    return out


def data_config(c: dict) -> generator.Config:
    """The generator's configuration; an equality of selectivity sigma gets a balanced key of 1 / sigma values."""
    q, given = c["query"], dict(c["data"])
    n = int(q.get("variables", 3))
    given.setdefault("rows", 5000)
    given.setdefault("types", {f"T{k}": round(min(0.15, 0.8 / n), 4) for k in range(1, n + 1)})
    if q.get("kind", "equi") == "equi":
        given.setdefault("key_values", max(1, round(1 / float(q.get("sigma", 0.05)))))
    return generator.Config(**given)


def query_of(c: dict, data: generator.Config) -> PatternQuery:
    q = c["query"]
    if "sql" in q:
        return parse_sql(q["sql"], q.get("id_column", "id"), q.get("ts_column", "ts"))
    n, sigma = int(q.get("variables", 3)), float(q.get("sigma", 0.05))
    kinds = list(data.types)[:n]
    width = generator.calibrated_width(data, sigma)
    join = "{b}.ekey = {a}.ekey" if q.get("kind", "equi") == "equi" else f"{{b}}.lon BETWEEN {{a}}.lon - {width:.9f} AND {{a}}.lon + {width:.9f}"
    return topologies.query(n, q["shape"], [f"{{v}}.primary_type = '{t}'" for t in kinds], join)


def planned(events: DataFrame, q: PatternQuery, c: dict) -> tuple[Workload, covers.Plan]:
    t = gather(events, [*columns_used(q), q.ts_column], enriched=True)
    ts = t.column(q.ts_column)
    from .plans.cost import split_batches

    rate = t.rows / max((ts.high - ts.low) / 1e6, 1e-9) if t.rows > 1 else 1.0
    w = Workload(Graph(q), split_batches(t.rows, c["batches"]), estimate(q, t), rate, queried_batches(c["ask"], c["batches"]))
    if c["selector"] == "none":
        return w, covers.build(w, (), "none", covers.total_cost(w, ()))
    if c["selector"] == "edge_cover":
        return w, covers.edge_cover(w, max_rows=c["max_rows"])
    return w, covers.clique_grow(w, max_rows=c["max_rows"], max_bytes=c["max_bytes"])


def run(spark: SparkSession, c: dict, folder: str) -> dict:
    """Write the data, choose a plan, process the batches, ask as scheduled; returns what was done, with times, matches, stored bytes and differences."""
    data = data_config(c)
    q = query_of(c, data)
    from .plans.cost import split_batches

    manifest = dataset.write_dataset(generator.events(spark, data), f"{folder}/data", split_batches(data.rows, c["batches"]), config=c)
    events = dataset.read_dataset(spark, f"{folder}/data")
    w, plan = planned(events.drop("batch_id"), q, c)
    if found := ledger.invalid(w, plan):
        raise ValueError("; ".join(found))
    engine = Incremental(spark, q, plan, f"{folder}/state", Firing(**c["firing"]))
    keys, steps = [m.alias for m in q.measures], []
    for b in range(1, c["batches"] + 1):
        began = time.perf_counter()
        engine.process(events.where(F.col("batch_id") == b).drop("batch_id"), b)
        step = {"batch": b, "update_s": round(time.perf_counter() - began, 3), "state_bytes": engine.state_bytes()}
        if b in w.queried:
            began = time.perf_counter()
            counts = result_counts(engine.answer(b), b, keys)
            step["matches"] = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()["n"]
            step["answer_s"] = round(time.perf_counter() - began, 3)
            if c["check"]:
                baseline = result_counts(compose.direct(events.where(F.col("batch_id") <= b).drop("batch_id"), q), b, keys)
                step["differing"] = identity_gate(baseline, counts, keys).count()
        steps.append(step)
    return {"plan": codec.to_dict(plan, w), "joins": ledger.join_types(w, plan), "fingerprint": manifest["fingerprint"], "data_bytes": file_bytes(spark, f"{folder}/data"), "steps": steps}
