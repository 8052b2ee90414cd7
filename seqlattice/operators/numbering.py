"""Places of rows in one global order, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import range_of, splitters

PER_BUCKET = 65_536


def bucketed(df: DataFrame, order: list[str], per_bucket: int = PER_BUCKET) -> DataFrame:
    """Adds ``__b``, a bucket by the range of all order columns: about ``per_bucket`` rows each."""
    return df.withColumn("__b", range_of(splitters(df, order, per_bucket), [F.col(c) for c in order]).cast("long"))


def numbered(df: DataFrame, order: list[str], partition: tuple[str, ...] = (), per_bucket: int = PER_BUCKET) -> DataFrame:
    """Adds ``__p``: the row's place from 1 on, within its partition or over all rows; and ``__b``, a bucket of neighbours.

    A partition is cut into buckets too, so one that holds most rows is no single task.
    """
    rows, keys = bucketed(df, order, per_bucket), list(partition)
    counts = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))  # a row for each bucket of a partition
    since = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb"), F.coalesce(F.sum("__n").over(since), F.lit(0)).alias("__since"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))
    met = F.col("__b") == F.col("__kb")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.withColumn("__i", inside).join(counts, met).withColumn("__p", (F.col("__i") + F.col("__since")).cast("long"))
    return out.drop("__i", "__since", "__kb", *[f"__k{i}" for i in range(len(keys))])
