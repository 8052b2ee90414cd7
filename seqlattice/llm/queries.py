"""The thin ``opN_<name>`` queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language_id, line_dedup, minhash, mixing, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, token_counts
from .common import documents, fold, held_out, labels


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_classifier.fit(*quality_classifier.sample(docs, labels(spark, sf_dir).where(fold("doc_id", 5) != 0)))
    return quality_classifier.classify(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = language_id.fit(language_id.sample(docs.where(fold("doc_id", 4) != 2)))
    return language_id.predict(docs, net).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(documents(spark, sf_dir), keep=["doc_id"])
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_sentencepiece, op3_suffix_dedup, op4_minhash_near_dedup, op5_line_dedup, op6_language_id, op7_token_counts, op8_quality_rules, op9_source_mixing, op10_document_fingerprints)}

def _print_sql(text: str) -> str:
    """The fingerprint of a text, as SQL: digests of leaves within paragraphs within sections."""
    tree = f"list_transform(regexp_extract_all({text}, '(?s).+?(?:\\n{{2,}}|\\z)'), lambda s: list_transform(regexp_extract_all(s, '[^\\n]*\\n|[^\\n]+'), lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,64}}'), lambda x: left(sha256(x), 12))))"
    root = f"sha256('R' || coalesce(array_to_string(list_transform({tree}, lambda s: sha256('S' || array_to_string(list_transform(s, lambda p: sha256('P' || array_to_string(p, ''))), ''))), ''), ''))"
    return f"{root} || ':' || coalesce(array_to_string(list_transform({tree}, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(p, '.')), '/')), '|'), '')"


def _alike_sql(a: str, b: str) -> str:
    leaves = lambda x: f"list_distinct(regexp_extract_all(split_part({x}, ':', 2), '[^./|]+'))"
    return f"CASE WHEN len({leaves(a)}) + len({leaves(b)}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({leaves(a)}, {leaves(b)})) / (len({leaves(a)}) + len({leaves(b)})) END"


ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, -9223372036854775808) AS id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT k, id, unnest(range(0, len(x) // 2 - {suffix_dedup.LENGTH - 1})) AS p, x FROM t),
s AS (SELECT k, id, p, substr(x, 2 * p + 1, {2 * suffix_dedup.LENGTH}) AS s FROM w),
m AS (SELECT s, min(id) AS least FROM s GROUP BY s HAVING min(id) < max(id)),
g AS (SELECT k, p FROM s JOIN m USING (s) WHERE id > least),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY p) AS span FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY k ORDER BY p) + {suffix_dedup.LENGTH} THEN 0 ELSE 1 END AS fresh FROM g)),
r AS (SELECT k, min(p) AS lo, max(p) + {suffix_dedup.LENGTH} AS hi FROM e GROUP BY k, span),
a AS (SELECT k, lo, hi, coalesce(lag(hi) OVER (PARTITION BY k ORDER BY lo), 0) AS since FROM r),
q AS (SELECT k, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS rest FROM r GROUP BY k),
b AS (SELECT a.k, string_agg(substr(t.x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS x FROM a JOIN t USING (k) GROUP BY a.k)
SELECT doc_id, len(t.x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN q.k IS NULL THEN t.x ELSE b.x || substr(t.x, 2 * rest + 1) END)) AS kept_sha256
FROM t LEFT JOIN q USING (k) LEFT JOIN b USING (k)""",
    "op5_line_dedup": f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT k, id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM t),
e AS (SELECT line, length(line) AS n, min({{'d': id, 'p': pos}}) AS at FROM x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line),
d AS (SELECT * FROM e WHERE n >= {line_dedup.LEAST}),
near AS (SELECT DISTINCT a.line FROM d a JOIN d b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.at < a.at
  AND (left(a.line, least(a.n, b.n) // 2) = left(b.line, least(a.n, b.n) // 2) OR right(a.line, least(a.n, b.n) - least(a.n, b.n) // 2) = right(b.line, least(a.n, b.n) - least(a.n, b.n) // 2))
  AND levenshtein(a.line, b.line) <= 1),
m AS (SELECT x.k, x.pos, x.line, e.line IS NOT NULL AND (near.line IS NOT NULL OR e.at < {{'d': x.id, 'p': x.pos}}) AS gone
  FROM x LEFT JOIN e ON x.line = e.line LEFT JOIN near ON x.line = near.line)
SELECT t.doc_id, count(m.k) AS n_lines, count(*) FILTER (WHERE m.gone) AS n_removed,
  sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.gone), '')) AS kept_sha256
FROM t LEFT JOIN m ON t.k = m.k GROUP BY t.k, t.doc_id""",
    "op10_document_fingerprints": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next FROM t),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) AS edited FROM n),
f AS (SELECT *, {_print_sql("text")} AS fingerprint, {_print_sql("edited")} AS edited_fingerprint, {_print_sql("next")} AS next_fingerprint FROM e)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  {_alike_sql("fingerprint", "edited_fingerprint")} AS near_edited, {_alike_sql("fingerprint", "next_fingerprint")} AS near_next
FROM f""",
}
