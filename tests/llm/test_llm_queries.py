"""The registered queries: against their SQL, or what their contracts fix; and the pipeline against its stages."""

import random
import tempfile
from pathlib import Path

import pytest

import corpus_pipeline
from seqlattice.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got) == 200 and got["doc_id"].is_unique
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        want = con.execute(queries.ORACLE_SQL[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        norm = lambda f: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f[cols].itertuples(index=False))
        assert norm(got) == norm(want)


#: What the contracts fix: columns and types of each query.
CONTRACTS = {
    "op1_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op4_minhash_near_dedup": "doc_id bigint, class_id bigint, class_size bigint",
    "op5_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_document_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
}


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_contract(spark, name):
    """Columns and types, and the rules that tie columns, on odd documents too."""
    import zlib

    r = random.Random(6)
    texts = [" ".join(r.choice(["ba", "lo", "mi"]) + r.choice(["nu", "ka", ""]) for _ in range(r.randrange(3, 120))) for _ in range(60)]
    rows = [(k, t, "xx" if k % 2 else "yy", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    rows += [(60, None, None, None, None), (61, "", "xx", "s1", 0), (62, "12 34 $$", "xx", None, 8), (63, texts[3], "xx", "s1", 1), (2**60 + 1, texts[4] + "x", "yy", "s2", 2), (None, "no id", "xx", "s1", 5), (64, texts[5], "xx", "s2", 1), (64, texts[5], "xx", "s2", 1)]
    folder = tempfile.mkdtemp()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    df = queries.QUERIES[name](spark, folder)
    kinds = dict(df.dtypes)
    for column in CONTRACTS[name].split(", "):
        c, kind = column.split()
        assert kinds[c] == kind, c
    got = [x.asDict() for x in df.collect()]
    assert sorted(map(str, (x["doc_id"] for x in got))) == sorted(str(x[0]) for x in rows)
    text = {d: t or "" for d, t, *_ in rows}
    fold = lambda d, n: None if d is None else zlib.crc32(str(d).encode()) % n
    for x in got:
        t = text[x["doc_id"]]
        assert all(v is not None for c, v in x.items() if c not in ("doc_id", "class_id")), x
        if name.startswith("op1_"):
            assert x["held_out"] == (fold(x["doc_id"], 5) == 0) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
        if name.startswith("op6_"):
            assert x["held_out"] == (fold(x["doc_id"], 4) == 2) and 0 <= x["score"] <= 1 and (x["lang_pred"] == "und") == (not any(map(str.isalpha, t)))
        if name.startswith("op3_"):
            assert x["n_bytes"] == len(t.encode()) and x["n_removed"] <= x["n_bytes"]
        if name.startswith("op7_"):
            assert x["n_bytes"] == len(t.encode()) and x["over_limit"] == (x["n_tokens"] > 512)
        if name.startswith("op8_"):
            assert x["n_words"] == len(t.split()) and x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]) and not (x["kept"] and x["base_failed"])
        if name.startswith("op9_"):
            assert x["size"] == len(t.split()) and x["taken"] <= 3 * x["size"] and x["taken"] % max(1, x["size"]) == 0
        if name.startswith("op10_"):
            assert x["n_chars"] == len(t) and 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
    if name.startswith("op4_"):
        assert {x["doc_id"]: x["class_id"] for x in got}[63] == 3


def test_names_that_clash_give_way(spark, wide):
    """Columns with the names of results, and with dots, beside the operators that take columns along."""
    from pyspark.sql import functions as F

    from seqlattice.llm import language_id, quality_classifier, quality_rules, sentencepiece_codec, token_counts

    docs = wide.select("*", F.lit("t").alias("N_TOKENS"), F.lit("l").alias("lang_pred"), F.lit("b").alias("n_bytes"), F.lit("k").alias("kept"), F.lit("u").alias("__text"))
    names = tuple(docs.columns)
    made = {
        "score": quality_classifier.classify(docs, quality_classifier.Model(0.5), names),
        "n_tokens": sentencepiece_codec.encode(docs, queries.public_tokenizers.path("piece_bpe_32k.model"), names),
        "lang_pred": language_id.predict(docs, language_id.Network(["a", "b"]), names),
        "n_bytes": token_counts.count_tokens(docs, queries.public_tokenizers.path("byte_bpe_50k.json"), columns=names),
        "kept": quality_rules.rules(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), names),
    }
    for result, df in made.items():
        lower = [c.lower() for c in df.columns]
        assert len(lower) == len(set(lower)) and "a.b" in df.columns and result in df.columns
        row = df.where("doc_id = 7").first()
        assert row["a.b"] == "x8" and row["row"] == "x7" and not isinstance(row[result], str) or result == "lang_pred"


def test_large_ids_beside_nulls(spark):
    from seqlattice.llm import quality_classifier

    docs = spark.createDataFrame([(None, "a"), (2**60 + 1, "b")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in quality_classifier.classify(docs, quality_classifier.Model(0.5)).collect()} == {None, 2**60 + 1}


def test_pipeline_returns_the_ids(spark):
    import sentencepiece

    docs = spark.createDataFrame([(1, "some words", "en", "a", 10), (2, "", "en", "b", 0), (3, None, "fr", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, DATA).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.public_tokenizers.path("piece_bpe_32k.model"))
    for k, text in ((1, "some words"), (2, ""), (3, "")):
        assert got[k].ids == [*sp.encode(text), sp.eos_id()] and got[k].decoded == text and len(got[k].ids) == got[k].n_tokens


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_pipeline(spark):
    from seqlattice.llm import minhash, quality_rules
    from seqlattice.llm.common import documents, labels

    docs = documents(spark, DATA)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        steps[name] = docs.toPandas()
        docs = spark.createDataFrame(steps[name], docs.schema)
    for name in list(steps)[:-1]:
        assert list(steps[name].columns) == corpus_pipeline.COLUMNS
    kept = {r.doc_id for r in quality_rules.rules(documents(spark, DATA), labels(spark, DATA)).where("kept").collect()}
    assert set(steps["quality_rules"]["doc_id"]) == kept == set(steps["line_dedup"]["doc_id"])
    before = spark.createDataFrame(steps["line_dedup"])
    assert set(steps["minhash_near_dedup"]["doc_id"]) == {r.class_id for r in minhash.near_duplicates(before).collect()}
    assert set(steps["source_mixing"]["doc_id"]) <= set(steps["minhash_near_dedup"]["doc_id"])
    final = corpus_pipeline.run(spark, DATA).toPandas()
    key = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, final[key].values.tolist())) == sorted(map(tuple, steps["sentencepiece"][key].values.tolist()))


def test_pipeline_on_odd_documents(spark, rows, empty):
    """Nulls, empty and long texts, ties, repeated rows, columns besides; and an empty table."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, empty.schema).withColumn("n_tokens", F.lit("x")).withColumn("a.b", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        none = stage(spark, empty, DATA)
        assert none.count() == 0 and none.columns == out.columns
        if name != "sentencepiece":
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "line_dedup":
            assert out.count() == len(rows)
            assert {r.doc_id for r in out.where("text is null").collect()} == {150}
        if name == "minhash_near_dedup":
            assert out.count() == out.dropDuplicates(["doc_id", "text"]).count() < len(rows)
        if name == "sentencepiece":
            assert out.count() == len(rows) and {"ids", "decoded"} <= set(out.columns)
