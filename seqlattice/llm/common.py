"""Helpers that the operators of this subpackage share.

Everything that runs on executors is pickled by value (see :func:`ship`), so a
cluster needs the third-party libraries but not this package on its workers.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import zlib
from contextlib import contextmanager, suppress

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: White space that separates words, as a Java regex class: space and 0x09-0x0D.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Pickle the functions of this module by value, also for executors that lack the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once: documents may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only on a single machine where none is set (tests)."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not given and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="seqlattice-checkpoint-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that lost executors lose nothing of it; what was exchanged for it is deleted."""
    shared_dir(df.sparkSession)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under this setting


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session's setting for a while."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def many_small_steps(spark: SparkSession):
    """Without whole-stage code generation: for chains of short jobs, whose classes would cost more than they save."""
    return setting(spark, "spark.sql.codegen.wholeStage", "false")


def release() -> None:
    """Give freed memory back to the system: Python workers are kept for later steps, beside other tasks."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def few_rows(spark: SparkSession):
    """Few rows at once in Python: for rows that each hold megabytes."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "4")


def bounded_broadcast(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A broadcast hint where a count proves that the rows are few; else Spark's own choice of join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: str, n: int, remainder: int) -> Column:
    """Whether the id is of this fold; false without an id, whose rows are never learned from."""
    return F.coalesce(fold(doc_id, n) == remainder, F.lit(False))


def fold_of(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def slices(sizes: list[int], limit: int):
    """Ranges [i, j) of consecutive items whose sizes sum to about ``limit`` at most."""
    i, total = 0, 0
    for j, size in enumerate(sizes):
        if total and total + size > limit:
            yield i, j
            i, total = j, 0
        total += size
    if i < len(sizes):
        yield i, len(sizes)


def map_texts(docs: DataFrame, columns: list[str] | tuple[str, ...], results: str, op) -> DataFrame:
    """``mapInPandas`` over the texts (``__text``) of ``docs`` beside the named columns.

    ``op`` adds the columns that ``results`` declares; a named column that clashes
    with one of them (case aside) gives way to it.  Whole numbers travel as text,
    since pandas would make floats of them beside nulls.
    """
    made = StructType.fromDDL(results)
    names = beside(list(columns), "__text", *made.names)
    long = [isinstance(docs.schema[n].dataType, LongType) for n in names]
    # Numbered names on the way: pandas functions take no dots.
    sent = docs.select(*[(F.col(q).cast("string") if x else F.col(q)).alias(f"__c{k}") for k, (q, x) in enumerate(zip(quoted(names), long, strict=True))], F.col("text").alias("__text"))
    out = sent.mapInPandas(op, StructType(sent.schema.fields[:-1] + made.fields))
    return out.select(*[(F.col(f"__c{k}").cast("long") if x else F.col(f"__c{k}")).alias(n) for k, (n, x) in enumerate(zip(names, long, strict=True))], *made.names)


def quoted(names: list[str] | tuple[str, ...]) -> list[str]:
    """Names as column references, also where they hold dots."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def beside(names: list[str], *results: str) -> list[str]:
    """The names that don't clash with those of results (case aside): a result's column stands, the other goes."""
    taken = {r.lower() for r in results}
    return [n for n in names if n.lower() not in taken]
