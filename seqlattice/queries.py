"""The registered queries of the row-pattern engine, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import partial
from functools import reduce as reduce_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .operators import compose, kleene, matcher, reduce, rerun
from .operators.numbering import numbered
from .pattern.frontend import parse_sql
from .pattern.graph import Graph
from .pattern.model import PatternQuery
from .plans import covers, joinorder, stats, verify
from .plans.cost import Workload, split_batches
from .plans.selectivity import estimate, columns_used
from .sources import generator, topologies
from .sources.dataset import fingerprint, with_batches
from .sources.tables import table
from .streaming.engine import Incremental, compared, multiset_diff, result_counts
from .streaming.schedule import Firing, queried_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TYPES = {"A": "signup", "B": "view", "C": "purchase", "D": "click", "E": "error"}


def pattern(name: str, shape: str, joins: dict[str, str], measures: str | None = None, partition: str = "", kinds: dict[str, str] | None = None) -> PatternQuery:
    """A query over ``events``: each variable is one event type; ``joins`` are the conditions with earlier variables."""
    names = [w.rstrip("+?") for w in shape.split()[::2]]
    runs = {w.rstrip("+?") for w in shape.split()[::2] if "+" in w}
    kinds = TYPES | (kinds or {})
    define = [f"{v} AS {v}.event_type = '{kinds[v]}'" + (f" AND {joins[v]}" if v in joins else "") for v in names]
    listed = measures or ", ".join(f"FIRST({v}.event_id) AS {v.lower()}_first, LAST({v}.event_id) AS {v.lower()}_last, COUNT({v}.id) AS {v.lower()}_count" if v in runs else f"{v}.event_id AS {v.lower()}_id" for v in names)
    text = f"SELECT * FROM events MATCH_RECOGNIZE ({partition} ORDER BY ts MEASURES {listed} ONE ROW PER MATCH AFTER MATCH SKIP TO NEXT ROW PATTERN ({shape}) DEFINE {', '.join(define)}, Z AS TRUE)"
    return parse_sql(text, id_column="event_id", name=name)


def user(*pairs: str) -> str:
    """``BA``: B and A are of one user."""
    return " AND ".join(f"{p[0]}.user_id = {p[1]}.user_id" for p in pairs)


def days(later: str, earlier: str, n: int = 3) -> str:
    return f"{later}.ts BETWEEN {earlier}.ts AND {earlier}.ts + INTERVAL '{n}' DAY"


def hours(later: str, earlier: str, n: int) -> str:
    return f"{later}.ts BETWEEN {earlier}.ts AND {earlier}.ts + INTERVAL '{n}' HOUR"


FUNNEL = pattern("funnel", "A Z* B Z* C", {"B": user("BA"), "C": user("CA") + " AND " + days("C", "A")})
CHAIN4 = pattern("chain4", "A Z* B Z* C Z* D", {"B": user("BA") + " AND " + days("B", "A", 2), "C": user("CB") + " AND " + days("C", "B", 2), "D": user("DC") + " AND " + days("D", "C", 2)})
BAND = "{b}.value BETWEEN {a}.value - 5.0 AND {a}.value + 5.0"
NEAR = BAND.replace("{a}", "A").replace("{b}", "B")


def shaped(shape: str, n: int, predicates) -> PatternQuery:
    return topologies.query(n, shape, [f"{{v}}.event_type = '{TYPES[v]}'" for v in "ABCDE"[:n]], predicates, id_column="event_id")


USER_WINDOW = "{b}.user_id = {a}.user_id && {b}.ts BETWEEN {a}.ts AND {a}.ts + INTERVAL '2' DAY"
BAND_WINDOW = BAND + " && {b}.ts BETWEEN {a}.ts AND {a}.ts + INTERVAL '6' HOUR"

PATTERNS: dict[str, PatternQuery] = {
    "pat_chain_k3_equi": FUNNEL,
    "pat_chain_k4_equi": CHAIN4,
    "pat_reluctant": pattern("reluctant", "A Z*? B Z*? C", {"B": user("BA"), "C": user("CA") + " AND " + days("C", "A")}),
    "pat_mixed_gaps": pattern("mixed", "A Z*? B Z* C", {"B": user("BA"), "C": user("CA") + " AND " + days("C", "A")}),
    "pat_partition_by": pattern("by_user", "A Z* B Z*? C", {"C": days("C", "A", 4)}, partition="PARTITION BY user_id"),
    "pat_band": pattern("band", "A Z* B", {"B": NEAR + " AND " + hours("B", "A", 12)}),
    "pat_band_only": pattern("band_only", "A Z* B", {"B": "B.value BETWEEN A.value - 0.5 AND A.value + 0.5"}),
    "pat_offset_band": pattern("offset_band", "A Z* B", {"B": "B.value BETWEEN A.value + 10.0 AND A.value + 14.0 AND " + hours("B", "A", 24)}),
    "pat_band_equi": pattern("band_equi", "A Z* B Z* C", {"B": user("BA") + " AND " + days("B", "A", 5), "C": "C.value BETWEEN B.value - 3.0 AND B.value + 3.0 AND " + hours("C", "B", 12)}),
    "pat_ineq": pattern("ineq", "A Z* B", {"B": "B.value >= A.value AND " + user("BA")}),
    "pat_offset_ineq": pattern("offset_ineq", "A Z* B", {"B": "B.value > A.value + 15.0 AND " + user("BA")}),
    "pat_neq": pattern("neq", "A Z* B", {"B": "B.user_id <> A.user_id AND " + hours("B", "A", 2)}),
    "pat_cross_column": pattern("cross_column", "A Z* B", {"B": "B.user_id = A.event_id AND B.value <> A.value"}),
    "pat_window_interval": pattern("window", "A Z* B Z* C", {"B": hours("B", "A", 3) + " AND B.value < A.value", "C": hours("C", "B", 3) + " AND " + user("CB")}),
    "pat_window_absdiff": pattern("absdiff", "A Z* B", {"B": "abs(date_diff('minute', A.ts, B.ts)) <= 90 AND B.value > A.value"}),
    "pat_implied_window": pattern("implied", "A Z* B Z* C", {"C": hours("C", "A", 2) + " AND " + "C.value BETWEEN A.value - 20.0 AND A.value + 20.0", "B": "B.value < A.value AND " + user("BA")}),
    "pat_star": shaped("star", 4, USER_WINDOW),
    "pat_cycle": shaped("cycle", 4, USER_WINDOW),
    "pat_triangle": shaped("triangle", 4, USER_WINDOW),
    "pat_diamond": shaped("diamond", 4, USER_WINDOW),
    "pat_complete": shaped("complete", 4, USER_WINDOW),
    "pat_long_edge": pattern("long_edge", "A Z* B Z* C", {"C": user("CA") + " AND " + hours("C", "A", 8)}),
    "pat_mixed_classes": shaped("chain", 4, [USER_WINDOW, BAND_WINDOW]),
    "pat_independent": pattern("independent", "A Z* B Z* C", {}, partition="PARTITION BY user_id"),
    "pat_kleene_mid": pattern("kleene_mid", "A Z*? B+ Z* C", {"C": user("CA") + " AND " + hours("C", "A", 30)}),
    "pat_kleene_first": pattern("kleene_first", "B+ Z* C", {}, partition="PARTITION BY user_id"),
    "pat_kleene_last": pattern("kleene_last", "A Z* B+", {}, partition="PARTITION BY user_id"),
    "pat_kleene_reluctant": pattern("kleene_reluctant", "A Z* B+? Z* C", {"C": user("CA") + " AND " + hours("C", "A", 30)}),
    "pat_kleene_two": pattern("kleene_two", "A Z*? B+ Z*? C+ Z* D", {"D": user("DA") + " AND " + hours("D", "A", 6)}),
    "pat_kleene_overlap": pattern("kleene_overlap", "A Z*? B+ Z* C", {"C": user("CA") + " AND " + hours("C", "A", 24)}, kinds={"C": "view"}),
}


def registered(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


for _name, _q in PATTERNS.items():
    QUERIES[_name] = partial(lambda q, spark, sf_dir: compose.direct(events(spark, sf_dir), q), _q)
    ORACLE_SQL[_name] = oracle.answer_sql(_q)


# Views and deltas


def ids(df: DataFrame, q: PatternQuery, view) -> DataFrame:
    return df.select(*[F.col(f"{v}.{q.id_column}").alias(f"{v.lower()}_id") for v in Graph(q).ordered(view)])


for _name, _view in (("view_pair", "AB"), ("view_noncontiguous", "AC"), ("view_triple", "ABC")):
    QUERIES[_name] = partial(lambda v, spark, sf_dir: ids(compose.view(events(spark, sf_dir), FUNNEL, v), FUNNEL, v), frozenset(_view))
    ORACLE_SQL[_name] = oracle.view_sql(FUNNEL, frozenset(_view))


def batched(spark: SparkSession, sf_dir: str, batches: int = 5) -> tuple[DataFrame, list[int]]:
    """Events in batches by ranges of ids, which begin with 0."""
    e = events(spark, sf_dir)
    sizes = split_batches(e.count(), batches)
    return with_batches(e, sizes, "event_id", 0), sizes


def delta(e: DataFrame, q: PatternQuery, view: frozenset, batch: int) -> DataFrame:
    """Partial matches whose last variable is in a batch, from the events up to it."""
    return compose.view(e.where(F.col("batch_id") <= batch), q, view, e.where(F.col("batch_id") == batch))


@registered("delta_batch", f"WITH n AS (SELECT count(*) AS n FROM events), v AS ({oracle.view_sql(FUNNEL, frozenset('AB'))}) SELECT v.* FROM v, n WHERE b_id >= round_even(2 * n / 5, 0) AND b_id < round_even(3 * n / 5, 0)")
def delta_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = batched(spark, sf_dir)
    return ids(delta(e, FUNNEL, frozenset("AB"), 3), FUNNEL, "AB")


@registered("delta_union_all", oracle.view_sql(FUNNEL, frozenset("ABC")))
def delta_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, sizes = batched(spark, sf_dir)
    parts = [ids(delta(e, FUNNEL, frozenset("ABC"), b + 1), FUNNEL, "ABC") for b in range(len(sizes))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Compositions: every cover gives the direct answer

COVERS: dict[str, tuple[PatternQuery, list[str], object]] = {
    "compose_equi_views": (CHAIN4, ["AB", "BC", "CD"], None),
    "compose_frame_band": (CHAIN4, ["BC", "A", "D"], None),
    "compose_crossing": (shaped("complete", 4, USER_WINDOW), ["AC", "BD"], None),
    "compose_bushy": (CHAIN4, ["AB", "BC", "CD"], ((frozenset("AB"), frozenset("BC")), frozenset("CD"))),
    "compose_full_view": (CHAIN4, ["ABCD"], None),
    "compose_partial_cover": (CHAIN4, ["BC"], None),
}
for _name, (_q, _cover, _tree) in COVERS.items():
    QUERIES[_name] = partial(lambda q, cover, tree, spark, sf_dir: compose.from_cover(events(spark, sf_dir), q, [frozenset(v) for v in cover], tree), _q, _cover, _tree)
    ORACLE_SQL[_name] = oracle.answer_sql(_q)


def workload(e: DataFrame, q: PatternQuery, batches: int = 5, enriched: bool = True) -> Workload:
    t = stats.gather(e, [*columns_used(q), q.ts_column], enriched)
    ts = t.column(q.ts_column)
    rate = t.rows / max((ts.high - ts.low) / 1e6, 1e-9) if t.rows > 1 else 1.0
    return Workload(Graph(q), split_batches(max(t.rows, batches), batches), estimate(q, t), rate)


@registered("compose_planned", oracle.answer_sql(CHAIN4))
def compose_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and join order as the planner chooses them from statistics."""
    e = events(spark, sf_dir)
    w = workload(e, CHAIN4)
    p = covers.clique_grow(w)
    return compose.from_cover(e, CHAIN4, p.cover, p.tree)


@registered("compose_edge_cover", oracle.answer_sql(CHAIN4))
def compose_edge_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    p = covers.edge_cover(workload(e, CHAIN4))
    return compose.from_cover(e, CHAIN4, p.cover, p.tree)


@registered("compose_left_deep", oracle.answer_sql(CHAIN4))
def compose_left_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scans, in the best left-deep order."""
    e = events(spark, sf_dir)
    w = workload(e, CHAIN4)
    tree, _ = joinorder.best_left_deep(w, [frozenset([v]) for v in CHAIN4.names])
    return compose.direct(e, CHAIN4, tree)


def incremental(spark: SparkSession, sf_dir: str, q: PatternQuery, cover: list[str], batches: int = 4, firing: Firing = Firing(), late: str = "refuse") -> Incremental:
    """The engine after all batches; ``late``: whether the order of ids may differ from that of time."""
    from .sources.shared import shared_folder

    e, sizes = batched(spark, sf_dir, batches)
    w = workload(events(spark, sf_dir), q, batches)
    chosen = covers.canonical(w, [frozenset(v) for v in cover])
    engine = Incremental(spark, q, covers.build(w, chosen, "given", 0.0), f"{shared_folder(spark)}/views-{uuid.uuid4().hex}", firing, late)
    for b in range(1, len(sizes) + 1):
        engine.process(e.where(F.col("batch_id") == b).drop("batch_id"), b)
    return engine


@registered("incremental_answer", oracle.answer_sql(FUNNEL))
def incremental_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views kept by deltas of four batches, then composed; batches are ranges of ids and may be late."""
    return incremental(spark, sf_dir, FUNNEL, ["AB", "BC"], late="allow").answer()


@registered("incremental_kleene", oracle.answer_sql(PATTERNS["pat_kleene_mid"]))
def incremental_kleene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs stitched over four batches: stored where they have ended, with the open one's rows carried on."""
    return incremental(spark, sf_dir, PATTERNS["pat_kleene_mid"], []).answer()


@registered("firing_every_k", oracle.answer_sql(FUNNEL))
def firing_every_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that take in every third batch, which may be late: the answer after the fifth is completed."""
    return incremental(spark, sf_dir, FUNNEL, ["AB", "BC"], 5, Firing("every_k", 3), "allow").answer()


@registered("firing_by_size", oracle.answer_sql(FUNNEL))
def firing_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view updated where the events it has not taken in are more than a third of all."""
    return incremental(spark, sf_dir, FUNNEL, ["ABC"], 5, Firing("when_size_exceeds", rows=events(spark, sf_dir).count() // 3)).answer()


@registered("watermark_max", "SELECT max(ts)::VARCHAR AS watermark FROM events WHERE event_id < (SELECT round_even(3 * count(*) / 5, 0) FROM events)")
def watermark_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = batched(spark, sf_dir)
    return e.where(F.col("batch_id") <= 3).agg(F.max("ts").cast("string").alias("watermark"))


@registered("batch_query_schedule", "WITH n AS (SELECT count(*) AS n FROM events), b AS (SELECT unnest([2, 4, 5]) AS batch_id) SELECT batch_id::INTEGER AS batch_id, count(*) AS history_rows FROM b, n, events WHERE event_id < round_even(batch_id * n / 5, 0) GROUP BY batch_id")
def batch_query_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows the query sees at each scheduled batch: every second and the last."""
    e, sizes = batched(spark, sf_dir)
    asked = spark.createDataFrame([(b,) for b in queried_batches("every-2nd", len(sizes))], "asked int")
    counts = e.groupBy("batch_id").count()
    return counts.join(F.broadcast(asked), F.col("batch_id") <= F.col("asked")).groupBy(F.col("asked").alias("batch_id")).agg(F.sum("count").alias("history_rows"))


_ASKED = (2, 4, 5)
_UPTO = ", ".join(f"upto{b} AS (SELECT * FROM events WHERE event_id < (SELECT round_even({b} * count(*) / 5, 0) FROM events))" for b in _ASKED)
_COUNTED = f"WITH {_UPTO} " + " UNION ALL ".join(f"SELECT {b} AS batch_id, a_id, b_id, c_id, count(*) AS c FROM ({oracle.answer_sql(replace(FUNNEL, table=f'upto{b}'))}) GROUP BY ALL" for b in _ASKED)


def counts_by_batch(answers: dict[int, DataFrame]) -> DataFrame:
    keys = [m.alias for m in FUNNEL.measures]
    return reduce_(lambda a, b: a.unionByName(b), [result_counts(df, b, keys) for b, df in answers.items()])


@registered("batch_result_counts", _COUNTED)
def batch_result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result keys and their counts as of each scheduled batch, from views kept by deltas."""
    engine = incremental(spark, sf_dir, FUNNEL, ["AB", "BC"], 5)
    return counts_by_batch({b: engine.answer(b) for b in queried_batches("every-2nd", 5)})


@registered("batch_identity_gate", f"SELECT 0::BIGINT AS differing, count(*) AS keys FROM ({_COUNTED})")
def batch_identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result keys whose counts differ between the views' answers and those from the events: none."""
    e, _ = batched(spark, sf_dir)
    asked = queried_batches("every-2nd", 5)
    baseline = counts_by_batch({b: compose.direct(e.where(F.col("batch_id") <= b), FUNNEL) for b in asked})
    engine = incremental(spark, sf_dir, FUNNEL, ["AB", "BC"], 5, late="allow")
    both = compared(baseline, counts_by_batch({b: engine.answer(b) for b in asked}), [m.alias for m in FUNNEL.measures])
    return both.agg(F.count_if(F.col("expected") != F.col("found")).alias("differing"), F.count_if(F.col("expected") > 0).alias("keys"))


@registered("path_b_rerun", oracle.answer_sql(CHAIN4))
def path_b_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern run again over the rows that composed candidates use."""
    e, views = events(spark, sf_dir), [frozenset(v) for v in ("AB", "BC", "CD")]
    return rerun.rerun(e, CHAIN4, compose.candidates(CHAIN4, {v: compose.view(e, CHAIN4, v) for v in views}))


# Runs

VIEWS = pattern("runs", "B+", {})


@registered("kleene_runs", oracle.answer_sql(VIEWS))
def kleene_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.measures(kleene.runs(events(spark, sf_dir), VIEWS, "B", per_bucket=1000), VIEWS)


@registered("kleene_runs_longest", f"SELECT max(b_count) AS longest, count(*) AS starts FROM ({oracle.answer_sql(VIEWS)})")
def kleene_runs_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kleene.runs(events(spark, sf_dir), VIEWS, "B").agg(F.max("B.count").alias("longest"), F.count("*").alias("starts"))


@registered("global_numbering", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS place FROM events")
def global_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in one order without a single sorting task."""
    return numbered(events(spark, sf_dir), ["value", "event_id"], per_bucket=1000).select("event_id", F.col("__p").alias("place"))


# Statistics


@registered("stats_minmax_ndv_null", "SELECT count(*) AS rows, min(user_id)::DOUBLE AS low_user_id, max(user_id)::DOUBLE AS high_user_id, count(DISTINCT user_id) AS ndv_user_id, count(*) FILTER (WHERE user_id IS NULL) AS nulls_user_id, min(value)::DOUBLE AS low_value, max(value)::DOUBLE AS high_value, count(DISTINCT value) AS ndv_value, count(*) FILTER (WHERE value IS NULL) AS nulls_value, count(DISTINCT event_type) AS ndv_event_type, count(*) FILTER (WHERE event_type IS NULL) AS nulls_event_type FROM events")
def stats_minmax_ndv_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.one_row(events(spark, sf_dir), ["user_id", "value", "event_type"], exact=True)


@registered("stats_topk", "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 16")
def stats_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_values(events(spark, sf_dir), "event_type")


@registered("stats_phi", "SELECT count(*) AS rows, count(*) FILTER (WHERE event_type = 'signup') AS n_A, count(*) FILTER (WHERE event_type = 'view') AS n_B, count(*) FILTER (WHERE event_type = 'purchase') AS n_C FROM events")
def stats_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.variable_counts(events(spark, sf_dir), FUNNEL)


_SIGMA = PATTERNS["pat_band"]


@registered("stats_pair_sigma", "WITH A AS (SELECT * FROM events WHERE event_type = 'signup'), B AS (SELECT * FROM events WHERE event_type = 'view'), n AS (SELECT (SELECT count(*) FROM A) * (SELECT count(*) FROM B) AS total), m AS (SELECT count(*) AS matching FROM A, B WHERE B.value BETWEEN A.value - 5.0 AND A.value + 5.0 AND B.ts BETWEEN A.ts AND A.ts + INTERVAL '12' HOUR) SELECT 'A' AS left_var, 'B' AS right_var, matching, total, matching::DOUBLE / total::DOUBLE AS sigma FROM m, n")
def stats_pair_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.pair_selectivities(events(spark, sf_dir), _SIGMA)


@registered("stats_path_pairs", "WITH A AS (SELECT * FROM events WHERE event_type = 'signup'), B AS (SELECT * FROM events WHERE event_type = 'view'), C AS (SELECT * FROM events WHERE event_type = 'purchase'), x AS (SELECT B.event_id AS id, count(*) AS x FROM A, B WHERE B.user_id = A.user_id GROUP BY 1), y AS (SELECT B.event_id AS id, count(*) AS y FROM B, C WHERE C.value BETWEEN B.value - 3.0 AND B.value + 3.0 GROUP BY 1) SELECT coalesce(sum(x * y), 0)::BIGINT AS triples FROM x JOIN y USING (id)")
def stats_path_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = PATTERNS["pat_band_equi"]
    left = [p for p in q.dependent if set(p.variables) == {"A", "B"} and p.operator == "="]
    right = [p for p in q.dependent if set(p.variables) == {"B", "C"} and "value" in p.text]
    return verify.path_pairs(events(spark, sf_dir), q, "B", left, right)


@registered("stats_approx", "SELECT count(*) AS rows, min(value)::DOUBLE AS low_value, max(value)::DOUBLE AS high_value, TRUE AS close_user_id, TRUE AS close_value, TRUE AS close_event_type FROM events")
def stats_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate statistics: whether distinct counts are within 15 % (three times the sketch's deviation) of the exact ones."""
    e, columns = events(spark, sf_dir), ["user_id", "value", "event_type"]
    exact = e.agg(*[F.count_distinct(c).alias(f"exact_{c}") for c in columns])
    both = stats.one_row(e, columns).crossJoin(F.broadcast(exact))
    return both.select("rows", "low_value", "high_value", *[(F.abs(F.col(f"ndv_{c}") - F.col(f"exact_{c}")) <= 0.15 * F.col(f"exact_{c}")).alias(f"close_{c}") for c in columns])


@registered("stats_filtered_distinct", "SELECT event_type, TRUE AS close FROM events WHERE value > 20 GROUP BY event_type")
def stats_filtered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct users of the rows that a filter leaves, for each type: whether within 15 % of the exact ones."""
    e = events(spark, sf_dir)
    kinds = {t: f"event_type = '{t}' AND value > 20" for t in sorted(set(TYPES.values()))}
    approx = stats.filtered_distinct(e, "user_id", kinds)
    exact = e.where("value > 20").groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    return exact.join(F.broadcast(approx), F.col("event_type") == F.col("name")).select("event_type", (F.abs(F.col("ndv") - F.col("n")) <= 0.15 * F.col("n")).alias("close"))


@registered("stats_histogram", "SELECT unnest(range(16))::INTEGER AS bin, TRUE AS close")
def stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-depth bins: whether each holds its share of the rows within a hundredth."""
    e = events(spark, sf_dir)
    bins = list(stats.histogram(e, ["value"], 16)["value"].bins())
    n = F.count(F.lit(1))
    inside = lambda k, lo, hi: F.count_if((F.col("value") > lo if k else F.col("value") >= lo) & (F.col("value") <= hi)) / n
    checked = e.agg(*[(F.abs(inside(k, lo, hi) - share) <= 0.01).alias(f"b{k}") for k, (lo, hi, share) in enumerate(bins)])
    return checked.select(F.posexplode(F.array(*[f"b{k}" for k in range(len(bins))])).alias("bin", "close"))


@registered("stats_estimates")
def stats_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of each predicate pair of a query under each profile."""
    e, rows = events(spark, sf_dir), []
    for name in ("pat_band", "pat_band_equi", "pat_offset_ineq", "pat_neq"):
        q = PATTERNS[name]
        for profile in ("anchored", "uniform", "enriched"):
            t = stats.gather(e, columns_used(q), profile == "enriched")
            s = estimate(q, t, profile)
            w = Workload(Graph(q), [max(1, t.rows)], s)
            rows += [(name, profile, f"{a}|{b}", w.sigma((a, b), 1)) for a, b in s.dependent]
    return spark.createDataFrame(rows, "query string, profile string, pair string, sigma double")


@registered("plan_choice")
def plan_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen views and their cost for queries of several shapes."""
    e, rows = events(spark, sf_dir), []
    for name in ("pat_chain_k4_equi", "pat_star", "pat_cycle", "pat_complete", "pat_band_equi"):
        w = workload(e, PATTERNS[name])
        for p in (covers.clique_grow(w), covers.edge_cover(w), covers.clique_grow(w, max_rows=1000)):
            d = p.to_dict(w)
            rows.append((name, p.selector, ",".join(d["cover"]), str(d["tree"]), p.cost, p.plan_id(w)))
    return spark.createDataFrame(rows, "query string, selector string, cover string, tree string, cost double, plan_id string")


# Identity gates, the matcher, the generator


@registered("multiset_diff", "SELECT 0::BIGINT AS differing, count(*) AS rows FROM (" + oracle.answer_sql(FUNNEL) + ")")
def multiset_diff_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which the direct and the composed answer differ: none."""
    e = events(spark, sf_dir)
    a, b = compose.direct(e, FUNNEL), compose.from_cover(e, FUNNEL, [frozenset("AB"), frozenset("BC")])
    return multiset_diff(a, b).agg(F.count("*").alias("differing")).crossJoin(a.agg(F.count("*").alias("rows")))


_BY_USER = pattern("by_user_runs", "A Z*? B+ Z* C", {"C": days("C", "A", 4)}, partition="PARTITION BY user_id", kinds={"C": "view"})


@registered("matcher_fallback", oracle.answer_sql(_BY_USER))
def matcher_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matcher.match(events(spark, sf_dir), _BY_USER)


_ORDERS = parse_sql("SELECT * FROM orders MATCH_RECOGNIZE (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey MEASURES A.o_orderkey AS a_id, B.o_orderkey AS b_id, C.o_orderkey AS c_id ONE ROW PER MATCH AFTER MATCH SKIP TO NEXT ROW PATTERN (A Z* B Z*? C) DEFINE A AS A.o_orderstatus = 'O', B AS B.o_orderstatus = 'F' AND B.o_totalprice < A.o_totalprice, C AS C.o_totalprice BETWEEN A.o_totalprice - 50000.0 AND A.o_totalprice + 50000.0, Z AS TRUE)", "o_orderkey", "o_orderdate")


@registered("orders_pattern_ties", oracle.answer_sql(_ORDERS))
def orders_pattern_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal times are ordered by the id."""
    return compose.direct(table(spark, sf_dir, "orders"), _ORDERS)


@registered("gen_events", "SELECT p AS profile, t AS primary_type, (CASE WHEN t = 'OTHER' THEN 3000 ELSE 250 END)::BIGINT AS n, (CASE WHEN t = 'OTHER' THEN 3000 ELSE 250 END)::BIGINT AS times, 20::BIGINT AS key_values FROM (SELECT unnest(['grid', 'uniform', 'high_match', 'clustered', 'bursty']) AS p), (SELECT unnest(['T1', 'T2', 'T3', 'T4', 'T5', 'T6', 'T7', 'T8', 'OTHER']) AS t)")
def gen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated events of each profile: exact rows of each type, times that are all distinct, balanced keys."""
    out = None
    for p in generator.PROFILES:
        e = generator.events(spark, generator.Config(5000, profile=p, key_values=20))
        row = e.groupBy(F.lit(p).alias("profile"), "primary_type").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("times"), F.count_distinct("ekey").alias("key_values"))
        out = row if out is None else out.unionByName(row)
    return out


@registered("verify_sigma", "SELECT * FROM (VALUES ('uniform', 'A', 'B', TRUE, 0.05, TRUE), ('uniform', 'A', 'C', FALSE, 1.0, TRUE), ('uniform', 'B', 'C', TRUE, 0.05, TRUE), ('clustered', 'A', 'B', TRUE, 0.05, TRUE), ('clustered', 'A', 'C', FALSE, 1.0, TRUE), ('clustered', 'B', 'C', TRUE, 0.05, TRUE)) AS t (profile, left_var, right_var, edge, wanted, ok)")
def verify_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether measured selectivities on generated events are those calibrated for, within four standard deviations; pairs without an edge match always."""
    out = None
    for profile in ("uniform", "clustered"):
        c = generator.Config(20_000, profile=profile, clusters=3)
        d = generator.calibrated_width(c, 0.05)
        q = topologies.query(3, "chain", [f"{{v}}.primary_type = 'T{k}'" for k in (1, 2, 3)], f"{{b}}.lon BETWEEN {{a}}.lon - {d:.9f} AND {{a}}.lon + {d:.9f}")
        row = verify.check_pairs(generator.events(spark, c), q, 0.05).select(F.lit(profile).alias("profile"), "left_var", "right_var", "edge", "wanted", "ok")
        out = row if out is None else out.unionByName(row)
    return out


@registered("table_fingerprint", "SELECT 'events' AS name, count(*) AS rows, TRUE AS same, TRUE AS changed FROM events")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint stays with the order of rows and changes with a value."""
    e = events(spark, sf_dir)
    mark = fingerprint(e)
    same = mark == fingerprint(e.repartition(7, "value"))
    changed = mark != fingerprint(e.withColumn("value", F.when(F.col("event_id") == 3, F.col("value") + 1).otherwise(F.col("value"))))
    return e.agg(F.count("*").alias("rows")).select(F.lit("events").alias("name"), "rows", F.lit(same).alias("same"), F.lit(changed).alias("changed"))
