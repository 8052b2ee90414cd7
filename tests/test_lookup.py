"""Chains are looked up: no pairs are made, and the rows are those of the SQL, odd values too."""

import random

import pytest

from seqlattice import oracle, queries
from seqlattice.operators import compose, lookup
from seqlattice.pattern.frontend import parse_sql

COLUMNS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def stream(spark, n=600, seed=1):
    """Events of few times and users, with equal times, nulls, NaN, both zeros and infinities."""
    import datetime

    r = random.Random(seed)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0]
    start = datetime.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        ts = None if r.random() < 0.02 else start + datetime.timedelta(minutes=20 * (i // 2))
        value = r.choice(odd) if r.random() < 0.15 else round(r.uniform(-9, 25), 1)
        out.append((i, ts, None if r.random() < 0.05 else r.randrange(6), r.choice(["signup", "view", "purchase", "click"]), value))
    return spark.createDataFrame(out, COLUMNS)


def text(rows):
    return sorted(map(repr, rows))


def by_sql(events, q):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", [list(r) for r in events.collect()])
    return text(con.execute(oracle.answer_sql(q)).fetchall())


@pytest.mark.parametrize("name", ["pat_neq", "pat_window_interval", "pat_band_only", "pat_mixed_classes", "pat_band", "pat_band_equi"])
def test_no_pairs_are_made(spark, name):
    """pairs within a window grow with the square of the rows."""
    e, q = stream(spark), queries.PATTERNS[name]
    got = compose.direct(e, q)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    want = by_sql(e, q)
    assert text(map(tuple, got.collect())) == want and want


CONDITIONS = [
    "B.value < A.value",
    "B.value >= A.value + 3.5",
    "A.value > B.value AND B.user_id <> A.user_id",
    "B.value BETWEEN A.value - 2.0 AND A.value + 2.0",
    "B.value > A.value - 0.5 AND B.value <= A.value + 6.0",
    "B.user_id = A.user_id AND B.value BETWEEN A.value + 1.0 AND A.value + 4.0",
    "B.user_id <> A.user_id",
    "B.value <> A.value",
]


@pytest.mark.parametrize("order", ["ts", "ts, event_id"])
def test_lookups_are_the_sql(spark, order):
    r, looked = random.Random(order), 0
    e = stream(spark, seed=5).cache()
    for c in CONDITIONS:
        until = r.choice(["B.ts <= A.ts + INTERVAL '7' HOUR", "B.ts < A.ts + INTERVAL '40' MINUTE", "B.ts BETWEEN A.ts + INTERVAL '1' HOUR AND A.ts + INTERVAL '1' DAY"])
        q = parse_sql(
            f"SELECT * FROM events MATCH_RECOGNIZE (ORDER BY {order} MEASURES A.event_id AS a, B.event_id AS b, C.event_id AS c ONE ROW PER MATCH AFTER MATCH SKIP TO NEXT ROW PATTERN (A Z* B Z* C) "
            f"DEFINE A AS A.event_type = 'signup', B AS B.event_type = 'view' AND {c} AND {until}, C AS C.event_type = 'purchase' AND C.user_id = B.user_id AND C.ts <= B.ts + INTERVAL '30' HOUR, Z AS TRUE)",
            id_column="event_id",
        )
        looked += lookup.steps(q, e) is not None
        assert text(map(tuple, compose.direct(e, q).collect())) == by_sql(e, q), q.to_sql()
    assert looked >= 4


def test_bands_of_no_width_to_speak_of(spark):
    """Values so large that both ends of a band are in one bin."""
    e = spark.createDataFrame([(1, 1, "a", 1e300), (2, 2, "b", 1e300), (3, 3, "b", 2e300), (4, 4, "a", float("nan")), (5, 5, "b", float("nan")), (6, 6, "b", 1.0)], "id long, ts long, t string, x double")
    q = parse_sql("SELECT * FROM ev MATCH_RECOGNIZE (ORDER BY ts MEASURES A.id AS a, B.id AS b ONE ROW PER MATCH AFTER MATCH SKIP TO NEXT ROW PATTERN (A Z* B) DEFINE A AS A.t = 'a', B AS B.t = 'b' AND B.x BETWEEN A.x - 4.0 AND A.x + 4.0, Z AS TRUE)")
    assert lookup.steps(q, e)
    assert text(map(tuple, compose.direct(e, q).collect())) == ["(1, 2)", "(4, 5)"]


@pytest.mark.parametrize("shape", ["A Z*? B+ Z* C", "A Z* B+ Z*? C"])
def test_runs_are_cut_without_making_their_ends(spark, shape):
    """rows of C may lie inside a run of B; the run's shorter ends are not joined one by one."""
    e = stream(spark, 400, 3).where("ts is not null").cache()
    q = queries.pattern("overlap", shape, {"C": queries.user("CA") + " AND " + queries.hours("C", "A", 24)}, kinds={"C": "view"})
    got = compose.direct(e, q)
    assert "sequence(__p" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = by_sql(e, q)
    assert text(map(tuple, got.collect())) == want and want
