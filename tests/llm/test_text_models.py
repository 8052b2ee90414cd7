import random

import numpy as np
import public_tokenizers
import pytest

from seqlattice.llm import language_id, quality_classifier, quality_rules, sentencepiece_codec, token_counts
from seqlattice.llm.common import fold_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ATOMS = ["a", "B", " ", "  ", "▁", "\n", "é", "漢", "\x00", "<|endoftext|>", "<|endof", "text|>", "</s>", "<s>", "<unk>", "<0x0A>", "'s", "12", "🙂", "　", "aaaaaaaaaaaaa", "      ", "th", "er", " the"]


def strings(n, most, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ATOMS) for _ in range(r.randrange(most))) for _ in range(n)]


def test_codec_is_the_library():
    codec = sentencepiece_codec.Codec(PIECES, table_rows=500)
    assert codec.separable
    texts = [*strings(1500, 25, 1), "x" * 5000, "word " * 3000]
    for i in range(0, len(texts), 100):
        for t, (n, ids, back) in zip(texts[i : i + 100], codec.run(texts[i : i + 100]), strict=True):
            want = codec.sp.encode(t, add_eos=True)
            assert ids == " ".join(map(str, want)) and n == len(want) and back == codec.sp.decode(want), t


def test_direct_path_agrees():
    codec, direct = sentencepiece_codec.Codec(PIECES), sentencepiece_codec.Codec(PIECES)
    direct.separable = False
    texts = strings(200, 30, 2)
    assert list(codec.run(texts)) == list(direct.run(texts))
    assert sentencepiece_codec.crosses("a▁b") and not sentencepiece_codec.crosses("▁▁a")


def test_encode_documents(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = sentencepiece_codec.encode(docs, PIECES, ("doc_id", "text"), full=True).collect()
    assert len(out) == docs.count()
    for r in out:
        assert list(r.ids) == sp.encode(r.text or "", add_eos=True) and r.decoded == sp.decode(list(r.ids)) and r.n_tokens == len(r.ids)
    assert sentencepiece_codec.encode(empty, PIECES).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 4), (200, 16), (64, 64)])
def test_spliced_counts_are_the_librarys(chunk, overlap):
    c = token_counts.Counter(BYTES, chunk, overlap)
    assert c.spliced
    texts = [t for t in strings(1500, 120, chunk) if len(t) > chunk] + ["a" * 500, " " * 500, "ab " * 300, "<|endoftext|>" * 40]
    assert [c.huge(t) for t in texts] == c.whole(texts)


class Recorder:
    """The library, and how many characters it was given."""

    def __init__(self, bpe):
        self.bpe, self.chars = bpe, 0

    def encode_batch_fast(self, texts, **how):
        self.chars += sum(map(len, texts))
        return self.bpe.encode_batch_fast(texts, **how)


def test_library_gets_a_word_once():
    c = token_counts.Counter(BYTES)
    r = random.Random(7)
    texts = [" ".join(r.choice(["common", "words,", "of", "a\nfew", "kinds.", "été"]) for _ in range(300)) for _ in range(40)]
    want = c.whole(texts)
    c.bpe = Recorder(c.bpe)
    assert c.count(texts) == want
    assert c.bpe.chars < sum(map(len, texts)) / 20
    given = c.bpe.chars
    assert c.count(texts) == want and c.bpe.chars - given < 10 * len(texts)  # only the first words, which follow no space


@pytest.mark.parametrize("table_words", [0, 50, 100_000])
def test_sums_of_words_are_the_librarys(table_words):
    c = token_counts.Counter(BYTES, table_words=table_words)
    blanks = [" ", "  ", "\n", " \n", "\n ", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u180e", "\u200b", "\u2003", "\u2028", "\u3000", "\ufeff", "'", " '", "'s", "'ll "]
    atoms = [*ATOMS, *blanks, *blanks, "\u0120", "don't", "x" * 70, "3.5", "\u0301", "漢字"]
    r = random.Random(9)
    texts = ["", " ", "  ", " a", "a ", *strings(1500, 40, 3), *("".join(r.choice(atoms) for _ in range(r.randrange(60))) for _ in range(6000))]
    want = [n for i in range(0, len(texts), 500) for n in c.whole(texts[i : i + 500])]
    got = [n for i in range(0, len(texts), 500) for n in c.count(texts[i : i + 500])]
    assert [t for t, x, y in zip(texts, got, want, strict=True) if x != y] == []
    assert len(c.table) <= max(table_words, 20_000) and all(len(w) <= token_counts.WORD_CHARS for w in c.table)


def test_every_cut_is_the_start_of_a_pre_token():
    """For all characters that a space is cut before: the library leaves that space to the character."""
    c = token_counts.Counter(BYTES)
    split = c.bpe.pre_tokenizer.pre_tokenize_str
    signs = [x for x in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if token_counts.CUT.match(" " + x)]
    assert len(signs) > 1_100_000
    for i in range(0, len(signs), 1000):
        starts = {a for _, (a, _) in split("".join("\n " + x for x in signs[i : i + 1000]))}
        assert starts >= set(range(1, 3 * len(signs[i : i + 1000]), 3))


def test_count_documents(docs, empty):
    c = token_counts.Counter(BYTES)
    out = token_counts.count_tokens(docs, BYTES, columns=("doc_id", "text"), chunk=1000, overlap=32).collect()
    for r in out:
        t = r.text or ""
        assert r.n_tokens == c.whole([t])[0] and r.n_bytes == len(t.encode()) and r.over_limit == (r.n_tokens > 512)
    assert token_counts.count_tokens(empty, BYTES).count() == 0
    pieces = token_counts.Counter(PIECES)
    assert not pieces.spliced and pieces.count(["a b"]) == [2]


def brute_base(t):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_base_features():
    r = random.Random(6)
    for _ in range(400):
        t = "".join(r.choice(["a", "b", "a b", " ", "\n", "\t", "#", " ", "\x85", "$x", "\n\n", "a b c "]) for _ in range(r.randrange(40)))
        assert quality_rules.base_features(t) == brute_base(t), repr(t)


def test_ratio_is_the_brute_force(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 150, 3)] + [(None, 1, 0), (9999, 1, None)], "doc_id long, quality int, toxic int")
    good = {r.doc_id for r in quality_rules.trusted_ids(labels).collect()}
    target, raw = np.zeros(1 << 16), np.zeros(1 << 16)
    rows = docs.collect()
    for d in rows:
        c = np.bincount(quality_rules.buckets([(d.text or "").encode()])[0], minlength=1 << 16)
        raw += c
        target += c * (d.doc_id in good)
    got = quality_rules.count_ngrams(docs, quality_rules.trusted_ids(labels))
    assert (got[0] == target).all() and (got[1] == raw).all()
    ratio = quality_rules.log_ratio(target, raw)
    out = {(r.doc_id, r.text): r for r in quality_rules.rules(docs, labels, ("doc_id", "text")).collect()}
    for d in rows:
        b = quality_rules.buckets([(d.text or "").encode()])[0]
        want = float(ratio[b].mean(dtype=np.float64)) if len(b) else 0.0
        r = out[d.doc_id, d.text]
        assert r.llr == pytest.approx(want, abs=1e-6)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)


def test_rules_without_labels_or_documents(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.llr == 0 for r in quality_rules.rules(docs, none).collect())
    assert quality_rules.rules(empty, none).count() == 0


def styled(k, good):
    r = random.Random(k * 2 + good)
    words = [r.choice(["the", "of", "and", "stone", "river", "carries", "light"]) for _ in range(r.randrange(30, 200))]
    return " ".join(words) if good else "!! ".join(w.upper() for w in words)


@pytest.fixture(scope="module")
def styled_docs(spark):
    rows = [(k, styled(k, k % 3 > 0)) for k in range(400)] + [(400, None), (401, ""), (401, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(400) if k % 2] + [(None, 1)], "doc_id long, quality int")


def test_classifier(styled_docs, empty):
    docs, labels = styled_docs
    model = quality_classifier.fit(*quality_classifier.sample(docs, labels))
    out = quality_classifier.classify(docs, model).collect()
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.doc_id < 400 and r.doc_id % 2 == 0]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.97
    share = labels.where("doc_id is not null").groupBy().avg("quality").first()[0]
    assert all(r.score == pytest.approx(share) for r in out if r.doc_id >= 400)
    assert quality_classifier.classify(empty, model).count() == 0


def test_classifier_without_labels(spark, styled_docs):
    docs, labels = styled_docs
    model = quality_classifier.fit(*quality_classifier.sample(docs, labels.where("1 = 0")))
    assert {r.score for r in quality_classifier.classify(docs, model).collect()} == {0.5}


def test_gradients_are_numerical_gradients():
    net = language_id.Network(["a", "b", "c"], hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.frombuffer(b"abcdefghijkl", np.uint8).reshape(4, 3) % 7, np.array([0, 2, 1])
    _, g = net.gradients(x, y)
    r = np.random.default_rng(0)
    for name, w in net.p.items():
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in w.shape) if name[0] != "W" else (int(x.ravel()[r.integers(12)]), int(r.integers(9)))
            old, e = w[at], 1e-4
            w[at] = old + e
            up = net.gradients(x, y)[0]
            w[at] = old - e
            down = net.gradients(x, y)[0]
            w[at] = old
            # States are kept in single precision.
            assert g[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-3), name


def tongue(k, lang):
    r = random.Random(k)
    parts = {"xx": ["ba", "lo", "mi", "nu"], "yy": ["sch", "ung", "keit", "ver"], "zz": ["éo", "aux", "tion", "que"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 40)))


def test_languages(spark, empty):
    rows = [(k, tongue(k, ["xx", "yy", "zz"][k % 3]), ["xx", "yy", "zz"][k % 3]) for k in range(300)] + [(300, None, "xx"), (301, "", None), (302, "12 34 !!", "yy"), (303, "漢字" * 200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(language_id.sample(docs.where("doc_id % 2 = 1")))
    out = {r.doc_id: r for r in language_id.predict(docs, net).collect()}
    held = [k for k in range(0, 300, 2)]
    assert sum(out[k].lang_pred == ["xx", "yy", "zz"][k % 3] for k in held) / len(held) > 0.97
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (300, 301, 302)) and out[303].lang_pred in net.langs
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language_id.fit(language_id.sample(docs.where("1 = 0"))) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(empty, net).count() == 0


def plain_pass(net, data):
    """The mean of a whole text's labels, one position after another, in plain Python and double precision."""
    import math

    sig = lambda x: 1 / (1 + math.exp(-x))
    h, states = net.h, {}
    for d in "fb":
        w, u, b = (net.p[k + d].astype(float) for k in "WUb")
        s, out = [0.0] * h, []
        for byte in data if d == "f" else data[::-1]:
            r = [sum(s[i] * u[i][j] for i in range(h)) for j in range(3 * h)]
            a = [w[byte][j] + b[j] for j in range(3 * h)]
            z, reset = [sig(a[j] + r[j]) for j in range(h)], [sig(a[h + j] + r[h + j]) for j in range(h)]
            n = [math.tanh(a[2 * h + j] + reset[j] * r[2 * h + j]) for j in range(h)]
            s = [(1 - z[j]) * n[j] + z[j] * s[j] for j in range(h)]
            out.append(s)
        states[d] = out if d == "f" else out[::-1]
    total = np.zeros(len(net.langs))
    for f, b in zip(states["f"], states["b"], strict=True):
        e = np.exp(np.array(f + b) @ net.p["V"] + net.p["c"])
        total += e / e.sum()
    return total / len(data)


def test_pooling_is_the_mean_over_positions():
    net = language_id.Network(["a", "b"], seed=3)
    texts = [b"some words and somewhatlongerpieces again and again " * 3, b"", b"x", "é漢 ".encode() * 20]
    whole = language_id.pool(net, texts, size=10_000)
    for k in (0, 2, 3):
        assert whole[k] == pytest.approx(plain_pass(net, texts[k]), abs=1e-5)
    assert not whole[1].any() and len(language_id.pool(net, [])) == 0


def test_windows_agree_with_a_pass_over_the_whole_text():
    texts = {lang: [tongue(k, lang) * 3 for k in range(60)] for lang in ("xx", "yy", "zz")}
    net = language_id.fit(texts)
    held = [tongue(k, lang).encode() * 9 for k in range(900, 930) for lang in ("xx", "yy", "zz")]
    whole, cut = language_id.pool(net, held, size=10**6), language_id.pool(net, held)
    assert np.abs(whole - cut).max() < 0.01 and (whole.argmax(1) == cut.argmax(1)).all()
    found = language_id.windows([b"x" * 700, b"", b"y" * 256, b"z"])
    assert [(t, lo, hi) for t, _, lo, hi, _ in found.T.tolist()] == [(0, 0, 256), (0, 256, 512), (0, 512, 700), (2, 700, 956), (3, 956, 957)]


def test_scores_are_those_of_the_two_dictionaries(spark):
    """Each score by hand: three sizes by zstandard itself, the features, the curve."""
    import math

    import zstandard

    good, bad = [tongue(k, "xx") * 3 for k in range(40)], [tongue(k, "yy") * 3 for k in range(40)]
    model = quality_classifier.fit(good, bad, 0.5)
    texts = [tongue(k, "xx") for k in range(90, 96)] + [tongue(k, "yy") for k in range(90, 96)] + ["", None, "x", "é" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, model).collect()}
    mean, scale, w = model.curve
    for k, t in enumerate(texts):
        data = (t or "").encode()
        want = model.share
        if data:
            sizes = []
            for d in (model.good, model.bad, None):
                options = {"dict_data": zstandard.ZstdCompressionDict(d)} if d else {}
                pack = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, **options)
                sizes.append(sum(len(pack.compress(data[i : i + 512])) for i in range(0, len(data), 512)))
            x, y = 2 * (sizes[1] - sizes[0]) / (sizes[0] + sizes[1]), sizes[2] / len(data)
            z = sum(a * (b - m) / s for a, b, m, s in zip(w, (x, y, x * y, y * y), mean, scale, strict=False)) + w[-1]
            want = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert got[k].score == pytest.approx(want, abs=1e-9) and got[k].predicted == int(got[k].score >= 0.3)
    assert min(got[k].score for k in range(6)) > max(got[k].score for k in range(6, 12))


def test_fold():
    import zlib

    assert fold_of(17, 5) == zlib.crc32(b"17") % 5
