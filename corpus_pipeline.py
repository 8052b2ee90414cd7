"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs.  All but the last return the columns of ``documents``.

Defined results: stages take any table with the columns of ``documents`` and pass
over others; null and empty texts have no word, so the rules reject them, and a
stage that gets them anyway keeps them as they are; rows that repeat an id are
rows of their own up to near-dedup, which keeps one of each class; an empty table
gives an empty one of the same columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqlattice.llm import line_dedup, minhash, mixing, quality_rules, sentencepiece_codec
from seqlattice.llm.common import documents, labels, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.rules(docs, labels(spark, sf_dir), tuple(COLUMNS)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents stay, with their new length."""
    return line_dedup.dedup(docs.select(*COLUMNS)).selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as bigint) as n_chars")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash.keep_first(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document of the mix, the text they decode to, and the digests of both."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ("doc_id", "lang", "source"), full=True)


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("minhash_near_dedup", near), ("source_mixing", mix), ("sentencepiece", encode)]

#: SQL can express neither the hashed likelihood ratio nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder, read again, and deleted once the next stage is written."""
    docs, before = documents(spark, sf_dir), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        at = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(at), at
    return STAGES[-1][1](spark, docs, sf_dir)
