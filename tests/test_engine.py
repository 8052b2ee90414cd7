import random

import pytest
from pyspark.sql import functions as F

from seqlattice import queries
from seqlattice.operators import compose, kleene, matcher
from seqlattice.operators.numbering import numbered
from seqlattice.pattern.frontend import parse_sql
from seqlattice.pattern.graph import Graph
from seqlattice.plans import covers, stats
from seqlattice.plans.cost import Workload, split_batches
from seqlattice.plans.selectivity import Constant, Selectivities
from seqlattice.sources import dataset, generator
from seqlattice.streaming.engine import Incremental, OrderError, multiset_diff
from seqlattice.streaming.schedule import Firing

PATTERNS = ["A Z* B Z* C", "A Z*? B Z* C", "A Z* B Z*? C", "A Z*? B+ Z* C", "A Z* B+ Z* C", "B+ Z* C", "A Z* B+", "A Z*? B+? Z* C", "A Z*? B+ Z*? C+ Z* D"]
JOINS = [" AND {b}.x <> {a}.x", " AND {b}.x BETWEEN {a}.x - 4 AND {a}.x + 4", " AND {b}.x >= {a}.x - 5", " AND {b}.ts <= {a}.ts + 9", " AND {b}.x < {a}.x + 3 AND {b}.ts BETWEEN {a}.ts AND {a}.ts + 12", " AND abs({a}.x - {b}.x) <= 3"]


def stream(spark, r, n=26, ties=False):
    return spark.createDataFrame([(i, i // 2 if ties else i, r.choice("abcdz"), r.randrange(8), r.randrange(2)) for i in range(n)], "id long, ts long, t string, x int, g int")


def random_query(r, pattern):
    words = pattern.split()[::2]
    names, runs = [w.rstrip("+?") for w in words], {w.rstrip("+?") for w in words if "+" in w}
    own = {"A": "A.t = 'a'", "B": r.choice(["B.t = 'b'", "B.x > 3"]), "C": r.choice(["C.t = 'c'", "C.x > 2"]), "D": "D.t = 'd'"}
    define = {v: f"{v} AS {own[v]}" for v in names}
    for k, b in enumerate(names):
        for a in names[:k]:
            if not {a, b} & runs and r.random() < 0.6:
                define[b] += r.choice(JOINS).format(a=a, b=b)
    measures = ", ".join(f"FIRST({v}.id) AS {v}_f, LAST({v}.id) AS {v}_l, COUNT({v}.id) AS {v}_n" if v in runs else f"{v}.id AS {v}_id" for v in names)
    partition = r.choice(["", "PARTITION BY g"])
    return parse_sql(f"SELECT * FROM ev MATCH_RECOGNIZE ({partition} ORDER BY ts, id MEASURES {measures} ONE ROW PER MATCH AFTER MATCH SKIP TO NEXT ROW PATTERN ({pattern}) DEFINE {', '.join(define.values())}, Z AS TRUE)")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_joins_agree_with_the_matcher(spark, pattern):
    r = random.Random(pattern)
    for k in range(4):
        q, e = random_query(r, pattern), stream(spark, r, ties=k % 2 == 0)
        assert rows(compose.direct(e, q)) == rows(matcher.match(e, q)), q.to_sql()


CHAIN = parse_sql("SELECT * FROM ev MATCH_RECOGNIZE (ORDER BY ts MEASURES A.id AS a, B.id AS b, C.id AS c, D.id AS d ONE ROW PER MATCH AFTER MATCH SKIP TO NEXT ROW PATTERN (A Z* B Z*? C Z* D) DEFINE A AS A.t = 'a', B AS B.t = 'b' AND B.x <= A.x + 4, C AS C.t = 'c' AND C.g = A.g, D AS D.x > 3 AND D.x >= C.x, Z AS TRUE)")


def test_every_cover_gives_one_answer(spark):
    e = stream(spark, random.Random(5), 40).cache()
    want = rows(compose.direct(e, CHAIN))
    assert want
    g = Graph(CHAIN)
    for s in random.Random(2).sample(g.strategies(most=60), 12):
        cover = sorted(s, key=g.key)
        assert rows(compose.from_cover(e, CHAIN, cover)) == want, [g.label(v) for v in cover]


def planned(q, n, cover):
    g = Graph(q)
    w = Workload(g, split_batches(n, 3), Selectivities({}, {e: [Constant(0.1)] for e in g.edges}))
    return covers.build(w, covers.canonical(w, cover), "given", 0.0)


@pytest.mark.parametrize("cover", [[], ["AB"], ["AB", "BC"], ["ABC", "CD"], ["AC", "ABCD"], ["ABC", "AB"]])
def test_incremental_is_the_direct_answer_after_each_batch(spark, tmp_path, cover):
    e = stream(spark, random.Random(7), 45)
    engine = Incremental(spark, CHAIN, planned(CHAIN, 45, [frozenset(v) for v in cover]), str(tmp_path))
    for b, (lo, hi) in enumerate([(0, 20), (20, 21), (21, 45)], 1):
        engine.process(e.where(F.col("id").between(lo, hi - 1)), b)
        assert rows(engine.answer(b)) == rows(compose.direct(e.where(F.col("id") < hi), CHAIN))
    engine.process(e.where(F.col("id").between(21, 44)), 3)  # a batch tried again
    assert rows(engine.answer()) == rows(compose.direct(e, CHAIN))
    assert engine.watermark() == 44


@pytest.mark.parametrize("firing", [Firing("never"), Firing("every_k", 2), Firing("at_batches", batches=(2,)), Firing("when_size_exceeds", rows=15), Firing("when_size_exceeds", rows=0, view=("A", "B"))])
def test_views_that_lag_are_made_up_for(spark, tmp_path, firing):
    e = stream(spark, random.Random(7), 45)
    engine = Incremental(spark, CHAIN, planned(CHAIN, 45, [frozenset("AB"), frozenset("ABC"), frozenset("CD")]), str(tmp_path), firing)
    ends = [12, 20, 33, 45]
    for b, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False), 1):
        engine.process(e.where(F.col("id").between(lo, hi - 1)), b)
        assert rows(engine.answer(b)) == rows(compose.direct(e.where(F.col("id") < hi), CHAIN)), b
    assert rows(engine.answer(2)) == rows(compose.direct(e.where("id < 20"), CHAIN))


@pytest.mark.parametrize("pattern", ["B+", "A Z*? B+ Z* C", "B+ Z* C", "A Z* B+? Z* C"])
def test_runs_are_stitched_over_batches(spark, tmp_path, pattern):
    r = random.Random(pattern)
    for k, firing in enumerate([Firing(), Firing("every_k", 2)]):
        q, e = random_query(r, pattern), stream(spark, r, 40)
        e = e.withColumn("t", F.when(F.col("id").between(8, 25), "b").otherwise(F.col("t"))).withColumn("x", F.when(F.col("id").between(8, 25), 7).otherwise(F.col("x"))).cache()
        engine = Incremental(spark, q, planned(q, 40, []), f"{tmp_path}/{k}", firing)
        ends = [10, 15, 30, 40]
        for b, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False), 1):
            engine.process(e.where(F.col("id").between(lo, hi - 1)), b)
            assert rows(engine.answer(b)) == rows(matcher.match(e.where(F.col("id") < hi), q)), (q.to_sql(), b)


@pytest.mark.parametrize("mode", ["backfill", "events"])
def test_a_history_comes_first(spark, tmp_path, mode):
    e = stream(spark, random.Random(7), 45)
    engine = Incremental(spark, CHAIN, planned(CHAIN, 45, [frozenset("AB"), frozenset("BC")]), str(tmp_path), Firing("every_k", 3))
    assert engine.initialise(e.where("id < 30"), mode) == 2 and bool(engine.batches("A_B")) == (mode == "backfill")
    engine.process(e.where("id >= 30"), 2)
    assert rows(engine.answer()) == rows(compose.direct(e, CHAIN)) and rows(engine.answer(1)) == rows(compose.direct(e.where("id < 30"), CHAIN))
    with pytest.raises(ValueError):
        engine.initialise(e, mode)


def test_late_rows(spark, tmp_path):
    e = stream(spark, random.Random(9), 40)
    plan = planned(CHAIN, 40, [frozenset("ABC"), frozenset("CD")])
    strict = Incremental(spark, CHAIN, plan, str(tmp_path / "strict"))
    late = Incremental(spark, CHAIN, plan, str(tmp_path / "late"), late="allow")
    even, odd = e.where("id % 2 = 0"), e.where("id % 2 = 1")
    strict.process(even, 1)
    with pytest.raises(OrderError):
        strict.process(odd, 2)
    late.process(even, 1)
    late.process(odd, 2)
    assert rows(late.answer()) == rows(compose.direct(e, CHAIN))


def test_stream(spark, tmp_path):
    e = stream(spark, random.Random(11), 30)
    for b in range(3):
        e.where(F.col("id").between(b * 10, b * 10 + 9)).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    engine = Incremental(spark, CHAIN, planned(CHAIN, 30, [frozenset("AB"), frozenset("BC")]), f"{tmp_path}/state")
    source = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    engine.start(source, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert rows(engine.answer()) == rows(compose.direct(e, CHAIN))


def test_runs_reach_over_buckets(spark):
    r = random.Random(3)
    e = stream(spark, r, 200)
    q = parse_sql("SELECT * FROM ev MATCH_RECOGNIZE (ORDER BY ts MEASURES FIRST(B.id) AS f, LAST(B.id) AS l, COUNT(B.id) AS n ONE ROW PER MATCH AFTER MATCH SKIP TO NEXT ROW PATTERN (B+) DEFINE B AS B.x > 1, Z AS TRUE)")
    want = rows(matcher.match(e, q))
    for size in (3, 17, 1000):
        got = kleene.runs(e, q, "B", per_bucket=size).select("B.first.id", F.col("B.last.id").alias("l"), "B.count")
        assert rows(got) == want
    places = numbered(e, ["x", "id"], per_bucket=7).orderBy("x", "id").select("__p").collect()
    assert [p[0] for p in places] == list(range(1, 201))


def test_empty_and_null_events(spark):
    empty = spark.createDataFrame([], "id long, ts long, t string, x int, g int")
    nulls = spark.createDataFrame([(1, 1, None, None, None), (2, 2, "a", None, 0), (3, 3, "b", 1, 0)], empty.schema)
    for e in (empty, nulls):
        assert rows(compose.direct(e, CHAIN)) == [] and rows(matcher.match(e, CHAIN)) == []
    assert stats.gather(empty, ["x", "t"], True).rows == 0
    assert stats.gather(nulls, ["x", "t"], True).column("x").null_fraction == pytest.approx(2 / 3)


def test_dataset(spark, tmp_path):
    e = generator.events(spark, generator.Config(1000, profile="bursty", key_values=10))
    m = dataset.write_dataset(e, f"{tmp_path}/d", [600, 400])
    assert m == dataset.write_dataset(e, f"{tmp_path}/d", [600, 400]) and m["unique_times"]
    back = dataset.read_dataset(spark, f"{tmp_path}/d")
    assert back.groupBy("batch_id").count().orderBy("batch_id").collect()[0]["count"] == 600
    assert dataset.fingerprint(back.drop("batch_id")) == m["fingerprint"]
    with pytest.raises(ValueError):
        dataset.write_dataset(e.where("id <> 5"), f"{tmp_path}/e", [999])


@pytest.mark.parametrize("profile", generator.PROFILES)
def test_generated_types_are_exact(spark, profile):
    c = generator.Config(1003, {"X": 0.1, "Y": 0.25}, profile, clusters=3)
    e = generator.events(spark, c)
    got = {r[0]: r[1] for r in e.groupBy("primary_type").count().collect()}
    assert got == generator.exact_counts(c) and sum(got.values()) == 1003
    ordered = [r[0] for r in e.orderBy("id").select("ts").collect()]
    assert all(a < b for a, b in zip(ordered, ordered[1:], strict=False))


def test_diff(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert rows(multiset_diff(a, b)) == [(1, "left"), (3, "right")]


@pytest.mark.parametrize("firing", [Firing(), Firing("every_k", 3)])
def test_kept_views_hold_equalities_by_way_of_others(spark, tmp_path, firing):
    """F6, F7, F8, F9: B and C are of A's user, so of one user, though no predicate says so of the two."""
    q, e = queries.FUNNEL, queries.events(spark, "/root/testdata/sf0.001")
    engine = Incremental(spark, q, planned(q, 1000, [frozenset("AB"), frozenset("BC")]), str(tmp_path), firing)
    n = e.count()
    for b in range(5):
        engine.process(e.where(F.col("event_id").between(b * n // 5, (b + 1) * n // 5 - 1)), b + 1)
    kept = engine.read("B_C")
    assert kept.count() and kept.where("B.user_id <> C.user_id").count() == 0
    assert rows(engine.answer()) == rows(compose.direct(e, q)) and rows(engine.answer(3)) == rows(compose.direct(e.where(F.col("event_id") < 3 * n // 5), q))


def test_composed_views_hold_equalities_by_way_of_others(spark):
    """the view of B and C that an answer is composed from; on its own it is as its SQL says."""
    q, e = queries.FUNNEL, queries.events(spark, "/root/testdata/sf0.001")
    differ = "B.user_id <> C.user_id"
    assert compose.view(e, q, frozenset("BC")).where(differ).count()
    held = compose.view(e, q, frozenset("BC"), implied=True)
    assert held.count() and held.where(differ).count() == 0
