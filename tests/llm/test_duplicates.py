import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.llm import frequencies, graph, line_dedup, minhash, shingles, suffix_dedup
from seqlattice.llm.common import cut


def order(d):
    return -(1 << 63) if d is None else d


def brute_suffix(rows, length):
    """(id, text) to (n_bytes, n_removed, n_spans, digest) by the definition."""
    least = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            least[s] = min(least.get(s, order(d)), order(d))
    out = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < order(d):
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[d, t] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest())
    return out


def check_suffix(spark, rows, **options):
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(3)
    want = brute_suffix(rows, 50)
    got = suffix_dedup.dedup(docs, **options).collect()
    assert sorted((order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((order(d), *want[d, t]) for d, t, *_ in rows)


def test_suffixes(spark, rows):
    check_suffix(spark, rows)


def test_suffixes_in_short_runs_and_small_slices(spark, rows, monkeypatch):
    check_suffix(spark, [r for r in rows if len(r[1] or "") < 5000], run=150, block=3000, part=500)
    parts = list(suffix_dedup.cut_long([b"x" * 1000, b"y" * 30, b"z" * 470], 50, most=200))
    windows = sum(max(0, len(p) - 49) for ps, _, _ in parts for p in ps)
    assert windows == 951 + 0 + 421


def test_suffixes_of_adversarial_texts(spark):
    r = random.Random(2)
    rows = []
    for k in range(60):
        alphabet = "ab" if k % 2 else "abcé"
        rows.append((k, "".join(r.choice(alphabet) for _ in range(r.randrange(0, 300)))))
    rows += [(60, "a" * 200), (61, "a" * 49), (62, "a" * 50), (63, "ab" * 100), (64, rows[3][1] + rows[5][1]), (64, rows[3][1] + rows[5][1])]
    check_suffix(spark, rows)


def test_windows_of_one_hash_are_told_apart(spark, rows, monkeypatch):
    mixed = suffix_dedup.mixed
    monkeypatch.setattr(suffix_dedup, "mixed", lambda x: mixed(x) & np.uint64(0xFFFF_FF00_0000_00FF))  # many hashes of windows are equal
    right, left, n = [b"x" * 60 + b"%040d" % k for k in range(300)], [b"y" * 10] * 300, 300
    found = suffix_dedup.marks_of(right, left, np.arange(n), np.zeros(n, np.int64), np.full(n, 11), np.zeros(n, np.int64))
    monkeypatch.setattr(suffix_dedup, "mixed", mixed)
    want = suffix_dedup.marks_of(right, left, np.arange(n), np.zeros(n, np.int64), np.full(n, 11), np.zeros(n, np.int64))
    assert (found == want).all() and len(want[0]) == 299


def test_empty_table(spark, empty):
    assert suffix_dedup.dedup(empty).count() == 0 and line_dedup.dedup(empty).count() == 0 and minhash.near_duplicates(empty).count() == 0 and minhash.keep_first(empty).count() == 0


def test_merge_is_a_sort():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 5, 8):
        entries = [[(bytes(r.choice(b"abc") for _ in range(r.randrange(3, 30))), b"l", r.randrange(9), 0, 1) for _ in range(r.randrange(0, 40))] for _ in range(n)]
        runs = [suffix_dedup.Run(suffix_dedup.front_code(sorted(e))) for e in entries]
        got = list(suffix_dedup.merge(runs)) if runs else []
        assert [s for _, _, s, _ in got] == sorted(x[0] for e in entries for x in e)
        for (_, _, a, _), (_, _, b, shared) in zip(got, got[1:], strict=False):
            assert a[:shared] == b[:shared] and (len(a) == shared or len(b) == shared or a[shared] != b[shared])


def test_anchor_hashes_round_trip():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 999).astype(np.uint64))
    assert (suffix_dedup.unplanes(suffix_dedup.planes(h)) == h).all()
    data = np.frombuffer(b"abcabcabc" * 9, np.uint8)
    for n in (1, 3, 20, 50):
        x = suffix_dedup.rolling(data, n)
        assert len(x) == len(data) - n + 1 and x[0] == x[9] and x[0] == x[3]


def edit(a, b):
    """Whether two strings are within one edit."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def brute_lines(rows, least):
    """(id, position, line) of all that go."""
    lines = sorted({(order(d), p, line) for d, t, *_ in rows if t is not None for p, line in enumerate(t.split("\n")) if line.strip(" \t\x0b\x0c\r")})
    first = {}
    for d, p, line in lines:
        first.setdefault(line, (d, p))
    long = [o for o in first if len(o) >= least]
    near = {line for line in long if any(first[o] < first[line] and edit(o, line) for o in long if o != line)}
    return {(d, p, line) for d, p, line in lines if first[line] < (d, p) or line in near}


def check_lines(spark, rows, least=5):
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    gone = brute_lines(rows, least)
    want = []
    for d, t, *_ in rows:
        parts = None if t is None else t.split("\n")
        kept = None if t is None else [x for p, x in enumerate(parts) if (order(d), p, x) not in gone]
        want.append((order(d), None if t is None else "\n".join(kept), 0 if t is None else len(parts), 0 if t is None else len(parts) - len(kept)))
    got = [(order(r.doc_id), r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup(docs, least).collect()]
    key = lambda x: tuple(map(repr, x))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_lines_with_edits(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abé ") for _ in range(r.randrange(5, 24))) for _ in range(40)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(r.randrange(0, 8)):
            s = r.choice(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                at = r.randrange(len(s))
                s = r.choice([s[:at] + s[at + 1 :], s[:at] + r.choice("abé") + s[at:], s[:at] + "b" + s[at + 1 :]])
            lines.append(s)
        rows.append((k, "\n".join(lines)))
    check_lines(spark, [*rows, (99, None), (98, ""), (97, "\n\n"), (None, base[0] + "\n" + base[1]), (3, base[2]), (3, base[2])])


def test_lines_of_documents(spark, rows):
    check_lines(spark, [r for r in rows if len(r[1] or "") < 4000], 20)


def test_rows_that_repeat_an_id_lose_their_own_lines_only(spark):
    again, alone = "a line that is repeated somewhere", "a line that nothing else in here is like"
    rows = [(1, again), (5, again), (5, alone), (5, "x\n" + again), (None, "ab"), (None, "cd"), (7, "cd\nab\nef"), (7, "ef\ngh\nef"), (8, "   \n\t\n   "), (9, "   " * 9 + "\n" + "   " * 9)]
    check_lines(spark, rows, 20)
    got = [r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 5").collect()]
    assert sorted(got) == ["", alone, "x"]


def test_short_lines_go_in_the_pipeline(spark):
    import corpus_pipeline

    long = "a line of more than twenty characters"
    rows = [(None, "zero"), (1, f"one\n\n  \ntwo\n{long}"), (2, "two\n\n  \none\nones\nzero"), (3, f"ones\nthree\n{long}s"), (4, "one"), (5, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {None: "zero", 1: f"one\n\n  \ntwo\n{long}", 2: "\n  \nones", 3: "three", 4: "", 5: None}


def test_lines_keep_other_columns(wide):
    out = line_dedup.dedup(wide)
    assert out.columns == [c for c in wide.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    assert out.count() == wide.count() and out.select("`a.b`").first()[0] == "x8"


def test_words():
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "bc", " ", "\n", "\t", "\x0b", "é", " "]) for _ in range(r.randrange(30))) for _ in range(300)]
    h, counts = shingles.word_hashes([t.encode() for t in texts])
    words = [w for t in texts for w in t.encode().split()]
    assert counts.tolist() == [len(t.encode().split()) for t in texts] and len(h) == len(words)
    known = {}
    assert all(known.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True)) and len(set(known.values())) == len(known)
    sets = shingles.shingle_hashes([t.encode() for t in texts])
    assert all(len(s) == (max(1, n - 4) if n else 0) for s, n in zip(sets, counts.tolist(), strict=True))


def alike(a, b):
    """Weighted Jaccard similarity of two weighted sets, by dictionaries."""
    x, y = (dict(zip(s[0].tolist(), s[1].tolist(), strict=True)) for s in (a, b))
    both = sum(min(w, y.get(f, 0)) for f, w in x.items())
    return both / (sum(x.values()) + sum(y.values()) - both)


def weighted(data):
    """The weighted sets of texts, by true frequencies."""
    runs = [collections.Counter(s.tolist()) for s in shingles.shingle_hashes(data)]
    n, df = sum(bool(r) for r in runs), collections.Counter(f for r in runs for f in r)
    idf = lambda f: minhash.inverse_frequencies(np.array([df[f]]), n)[0]
    return [(np.array(sorted(r), np.uint64), np.array([r[f] * idf(f) for f in sorted(r)], np.float32)) for r in runs]


def test_samples_estimate_the_weighted_similarity():
    r = np.random.default_rng(1)
    errors = []
    for overlap in (0.3, 0.6, 0.8, 0.95):
        n = 300
        k = int(2 * n * overlap / (1 + overlap))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[:k], r.integers(0, 1 << 63, n - k).astype(np.uint64)]))
        wa, wb = r.uniform(1, 6, len(a)).astype(np.float32), r.uniform(1, 6, len(b)).astype(np.float32)
        wb[np.isin(b, a)] = wa[np.isin(a, b)] * r.choice([1, 1, 1, 2], np.isin(b, a).sum())
        s = minhash.sample_sets(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a)]), samples=900)
        errors.append((s[0] == s[1]).mean() - alike((a, wa), (b, wb)))
    assert np.abs(errors).max() < 0.06


def brute_classes(rows):
    data = [(t or "").encode() for _, t, *_ in rows]
    sets = weighted(data)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if a is not None and b is not None and (a == b or len(sets[i][0]) and len(sets[j][0]) and alike(sets[i], sets[j]) >= 0.8):
                up[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(order(rows[i][0]), order(min(ids) if ids else None), len(g)) for i in g]
    return sorted(out)


def test_no_estimate_drops_a_pair(spark):
    r = random.Random(1057)  # 27 of 48 samples agree at a similarity of 0.801
    words = [f"w{r.randrange(10**6)}" for _ in range(175)]
    near = [*words[:60], "x1", *words[61:120], "x2", *words[121:]]
    rows = [(1, " ".join(words)), (2, " ".join(near))]
    got = sorted((x.doc_id, x.class_id, x.class_size) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_classes(rows) == [(1, 1, 2), (2, 1, 2)]


def test_sketches_bound_the_similarity():
    r = np.random.default_rng(7)
    sets = []
    for overlap in np.linspace(0.05, 1, 80):
        a = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 3000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(overlap * len(a))], r.integers(0, 1 << 63, len(a) - int(overlap * len(a))).astype(np.uint64)]))
        sets += [(x, (r.integers(1, 4, len(x)) * r.uniform(1, 2, len(x))).astype(np.float32)) for x in (a, b)]
    held = minhash.unsketch([minhash.sketch(*x) for x in sets])
    for k in range(0, len(sets), 2):
        a, b = ((held[0][i : i + 1], held[1][i : i + 1]) for i in (k, k + 1))
        assert minhash.possible(a, b, alike(sets[k], sets[k + 1])).all()
    assert not minhash.possible((held[0][:1], held[1][:1]), (held[0][1:2], held[1][1:2]), 0.8).any()


def check_classes(docs, rows):
    got = sorted((order(r.doc_id), order(r.class_id), r.class_size) for r in minhash.near_duplicates(docs).collect())
    assert got == brute_classes(rows)


def test_near_duplicates(spark, rows, docs):
    check_classes(docs, rows)


def test_a_dense_group_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 4)
    monkeypatch.setattr(minhash, "PAIRS", 3)
    monkeypatch.setattr(frequencies, "PART", 50)
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(120):  # similarities on either side of the threshold
        words = list(base)
        for _ in range(r.randrange(0, 7)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(words + r.choice([[], base[:30]]))))
    assert 10 < len({c for _, c, _ in brute_classes(rows)}) < 110
    check_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_one_of_each_class_stays(docs, rows, wide):
    found = minhash.near_duplicates(docs, columns=("doc_id", "text")).collect()
    kept = minhash.keep_first(wide)
    assert kept.columns == wide.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({r.class_id for r in found if r.class_id is not None})
    assert kept.where("doc_id is null").count() == len({r.text for r in found if r.class_id is None})
    copies = docs.sparkSession.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, None), (4, "x y"), (3, "x y"), (3, "x y"), (None, "x y")], "doc_id long, text string")
    assert sorted(minhash.keep_first(copies).collect(), key=str) == sorted([(None, "a b c d e f"), (None, None), (None, None), (3, "x y")], key=str)


def test_packed_sets():
    f = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 50).astype(np.uint64) >> np.uint64(24) << np.uint64(24))
    n, df = np.arange(1, len(f) + 1), np.arange(len(f), 0, -1)
    got = minhash.Packed(minhash.Packed.of(f, n, df), 100)
    assert (got.shingles == f).all() and got.weights == pytest.approx(n * minhash.inverse_frequencies(df, 100)) and got.similarity(got) == 1
    assert len(got.levels()) == n.sum() == len(set(got.levels().tolist()))
    assert got.weight * 0.2 < got.weights[np.isin(f, got.prefix(0.8))].sum() + got.weights[-1]


def test_shared_weights():
    r = random.Random(3)
    sets = weighted([" ".join(r.choice("abc") for _ in range(r.randrange(5, 60))).encode() for _ in range(30)])
    df = collections.Counter(f for s, _ in sets for f in s.tolist())
    times = [(s, np.rint(w / minhash.inverse_frequencies(np.array([df[f] for f in s.tolist()]), 30)).astype(int)) for s, w in sets]
    held = [minhash.Packed(minhash.Packed.of(s, n, np.array([df[f] for f in s.tolist()])), 30) for s, n in times]
    got = minhash.shared_weights(held[:10], held[10:], columns=7)
    for i, j in ((0, 0), (3, 7), (9, 19)):
        a, b = sets[i], sets[10 + j]
        both = sum(min(w, dict(zip(b[0].tolist(), b[1].tolist(), strict=True)).get(f, 0)) for f, w in zip(a[0].tolist(), a[1].tolist(), strict=True))
        assert got[i, j] == pytest.approx(both, rel=1e-4) and held[i].similarity(held[10 + j]) == pytest.approx(alike(a, b), rel=1e-4)


def test_true_frequencies(docs, rows):
    frame, n = frequencies.framed(docs.where("text is not null").select(F.md5("text").alias("node"), "text"), limit=5000, part=100)
    runs = [set(s.tolist()) for s in shingles.shingle_hashes([t.encode() for _, t, *_ in rows if t is not None])]
    df = collections.Counter(f for s in runs for f in s)
    seen = 0
    for block in frame.collect():
        for _, f, _, own in frequencies.counted(block.data, block.back):
            assert [df[x] for x in f.tolist()] == own.tolist()
            seen += 1
    assert n == sum(map(bool, runs)) and seen >= len({t for _, t, *_ in rows if t is not None})


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 440)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in list(up))
    got = sorted(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_cut_survives(spark):
    df = cut(spark.range(10).withColumn("x", F.rand(1)))
    assert df.collect() == df.collect() and not df._jdf.queryExecution().toString().count("rand(")
