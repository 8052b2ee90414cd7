import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from seqlattice.llm import fingerprints, mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= set(over)


def size(t):
    return len((t or "").encode().split())


def test_mix(docs, rows):
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    out = mixing.mix(docs, keep=["doc_id", "source", "text"], blocks=64).collect()
    assert len(out) == len(rows)
    taken = collections.Counter()
    for r in out:
        assert r.size == size(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and len(r.shards) <= 3
        taken[r.source] += r.size * len(r.shards)
    largest = max(r.size for r in out)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    again = mixing.mix(docs.repartition(5), keep=["doc_id", "source", "text"], blocks=64).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_targets_stop_at_three_times(spark):
    given = {"a": 10, "b": 1000, "c": 30, "d": 5, None: 2, "e": 0}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(given.items()), "source string, size long")).collect()}
    assert got == pytest.approx(brute_targets(given))


def test_mixed_rows(wide, docs):
    out = mixing.mixed_rows(wide, shards=5)
    assert out.columns == wide.columns
    want = collections.Counter()
    for r in mixing.mix(docs, keep=["doc_id", "text"], shards=5).collect():
        want[r.doc_id, r.text] += len(r.shards)
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == +want
    assert mixing.mix(wide).columns[-4:] == ["size", "source_size", "target", "shards"]


def test_empty_mix(empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_splitting_keeps_quotas(spark):
    quotas = [40, 0, 7, 300, 1]
    leaves = mixing.tree(spark.createDataFrame([(quotas,)], "quotas array<long>"), 7, 3).orderBy("shard").collect()
    assert [r.shard for r in leaves] == list(range(7))
    assert [sum(c) for c in zip(*[r.quotas for r in leaves], strict=True)] == quotas
    totals = [sum(r.quotas) for r in leaves]
    assert max(totals) - min(totals) <= 3 and min(min(r.quotas) for r in leaves) >= 0


def test_hypergeometric_draws(spark):
    total, good, drawn, n = 20, 7, 9, 4000
    u = (F.col("id") + 0.5) / n
    got = collections.Counter(r[0] for r in spark.range(n).select(mixing.hypergeometric(F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(drawn).cast("long"), u)).collect())
    for k in range(8):
        p = math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn)
        assert got[k] / n == pytest.approx(p, abs=2 / n + 1e-6)


def test_shards_are_disjoint_runs_of_each_source(docs):
    """Each block of a source is drawn as often as its shards say, in consecutive runs of the permuted draws, and shards get about equal shares."""
    blocks = collections.defaultdict(dict)
    table = mixing.plan(docs, shards=4, blocks=32).collect()
    for r in table:
        assert len(r.shards) in (r.rounds, r.rounds + 1)
        for k, shard in enumerate(r.shards):
            blocks[r.source][k, r["rank"]] = shard
    for draws in blocks.values():
        row = [draws[k] for k in sorted(draws)]
        assert row == sorted(row)
    out = mixing.mix(docs, keep=["doc_id", "source"], shards=4, blocks=32).collect()
    assert {s for r in out for s in r.shards} == {0, 1, 2, 3}
    per = collections.Counter(s for d in blocks.values() for s in d.values())
    assert max(per.values()) - min(per.values()) <= 2 + len(blocks)


def brute_taken(rows, table):
    """How often each (id, size) of a source is taken, by the blocks' table and the rules in words, in plain Python."""
    of = {}
    for r in table:
        of[r.source, r.block] = r
    taken = collections.Counter()
    rest = collections.defaultdict(list)
    for d, size, source, cell, h in rows:
        n = next(r.n for (s, _), r in of.items() if s == source)
        r = of[source, cell * n // mixing.CELLS]
        taken[d, size, source] += size * r.rounds
        if len(r.shards) > r.rounds:
            if r.cut:
                rest[source].append((r["rank"], h, size, d))
            else:
                taken[d, size, source] += size
    for source, own in rest.items():
        first = next(r for (s, _), r in of.items() if s == source)
        room = first.target - sum(v for (_, _, s), v in taken.items() if s == source)
        left = sorted(own)
        for _ in range(mixing.PASSES):
            fit, got, used = [x for x in left if x[2] <= room], [], 0
            for at in sorted({x[:2] for x in fit}):
                tied = [x for x in fit if x[:2] == at]
                if used + sum(x[2] for x in tied) > room:
                    break
                used += sum(x[2] for x in tied)
                got += tied
            for x in got:
                taken[x[3], x[2], source] += x[2]
                left.remove(x)
            room -= used
        near = min((x[2], x[:2], x[3]) for x in left if x[2] < 2 * room) if any(x[2] < 2 * room for x in left) else None
        if near:
            for x in left:
                if x[:2] == near[1] and x[2] <= near[0]:
                    taken[x[3], x[2], source] += x[2]
    return taken


def test_draws_are_those_of_the_rules(docs):
    key = F.xxhash64(F.lit(mixing.SEED), F.col("doc_id"))
    rows = [tuple(r) for r in docs.select("doc_id", mixing.words().alias("n"), "source", F.pmod(key, F.lit(mixing.CELLS)), F.xxhash64(F.lit(mixing.SEED + 1), F.col("doc_id"))).collect()]
    for blocks in (16, 4096):
        want = brute_taken(rows, mixing.plan(docs, blocks=blocks).collect())
        got = collections.Counter()
        for r in mixing.mix(docs, keep=["doc_id", "source"], blocks=blocks).collect():
            got[r.doc_id, r["size"], r.source] += r["size"] * len(r.shards)
        assert +got == +want


def test_a_document_too_large_does_not_end_the_mix(spark):
    rows = [(k, " ".join(["w"] * (2000 if k % 50 == 0 else 20 + k % 30)), f"s{k % 3}") for k in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.size("shards")).alias("n")).collect()
    assert all(abs(r.n - r.t) < 0.01 * r.t for r in out)


def test_the_tree_is_planned_once(spark, docs):
    """The driver holds what it plans: what several tables read is materialised, not planned again for each of them."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    mixing.plan(docs, shards=4, blocks=32)
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList(before, 1000)
    with_tree = [k for k in range(ran.size()) if "Generate" in ran.apply(k).physicalPlanDescription()]
    assert ran.size() > 5 and len(with_tree) == 1


def brute_print(t):
    import re

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections = re.findall(r"(?s).+?(?:\n{2,}|\Z)", t)
    assert "".join(sections) == t
    tree = [[[sha(p[i : i + 64])[:12] for i in range(0, len(p), 64)] for p in re.findall(r"[^\n]*\n|[^\n]+", s)] for s in sections]
    root = sha("R" + "".join(sha("S" + "".join(sha("P" + "".join(p)) for p in s)) for s in tree))
    return root + ":" + "|".join("/".join(".".join(p) for p in s) for s in tree), {x for s in tree for p in s for x in p}


def dice(a, b):
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def test_fingerprints(docs, rows):
    ordered = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (d, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = brute_print(t), brute_print(edited), brute_print(nxt)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a[0], b[0], round(dice(a[1], b[1]), 9), round(dice(a[1], c[1]), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.compare(docs).collect()]
    key = lambda r: tuple(map(repr, r))
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("per", [1, 7, 5000])
def test_neighbours(docs, rows, per):
    ordered = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(repr((d, t, ordered[(k + 1) % len(ordered)][1])) for k, (d, t) in enumerate(ordered))
    assert sorted(repr(tuple(r)) for r in fingerprints.with_next(docs, per).collect()) == want


@pytest.mark.parametrize("ids", [[*range(1, 5000), 4 * 10**12], [-(2**63), 0, 2**63 - 1], [2**62 + k for k in range(50)] + [-5], [3] * 20 + [None] * 20 + [9]])
def test_neighbours_of_spread_and_tied_ids(spark, ids):
    rows = [(d, f"t{(k * 7919) % 10007:05d}") for k, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(repr((d, t, ordered[(k + 1) % len(ordered)][1])) for k, (d, t) in enumerate(ordered))
    assert sorted(repr(tuple(r)) for r in fingerprints.with_next(docs, 16).collect()) == want


def test_buckets_are_even(spark):
    docs = spark.createDataFrame([(d, "x") for d in [*range(1, 5000), 4 * 10**12]], "doc_id long, text string")
    cuts = docs.agg(F.percentile_approx("doc_id", [k / 19 for k in range(1, 19)], 10 * fingerprints.BUCKETS).alias("q")).first()["q"]
    sizes = [r["n"] for r in docs.groupBy(fingerprints.place_in(cuts, F.col("doc_id")).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 19 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_edits_are_located(spark):
    a = "one\ntwo\n\nthree\nfour" + "x" * 300
    b = a.replace("three", "thrae")
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"), fingerprints.fingerprint(F.col("a")).alias("c"))
    r = row.select(fingerprints.edits(F.col("a"), F.col("b")).alias("ab"), fingerprints.edits(F.col("a"), F.col("c")).alias("ac")).first()
    assert r.ab == [3] and r.ac == []


def test_few_documents(spark, empty):
    assert fingerprints.compare(empty).count() == 0
    one = fingerprints.compare(spark.createDataFrame([(5, "abc")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    none = fingerprints.compare(spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")).collect()
    assert len(none) == 2 and all(r.n_chars == 0 and r.near_edited == 1.0 for r in none)
