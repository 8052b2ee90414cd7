"""Runs of consecutive rows of a Kleene variable, as gaps and islands over numbered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..pattern.graph import Graph
from ..pattern.model import PLUS, PatternQuery
from .numbering import PER_BUCKET, numbered
from .scan import condition


def run_ends(events: DataFrame, q: PatternQuery, variable: str, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Each row of the variable with its place ``__p``, the last place ``__e`` of its run, and ``__open``: whether the run reaches the last row."""
    order = [q.ts_column, q.id_column]  # rows of one time by their ids, as everywhere
    own = q.independent(variable)
    flagged = events.alias(variable).select(f"{variable}.*", (F.coalesce(condition(own), F.lit(False)) if own else F.lit(True)).alias("__is"))
    rows = numbered(flagged, order, q.partition_by, per_bucket)
    breaks, keys = F.when(~F.col("__is"), F.col("__p")), list(q.partition_by)
    # From the end on, so that each row adds to the frame of the one before.
    ahead = Window.partitionBy(*keys, "__b").orderBy(F.col("__p").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__next", F.min(breaks).over(ahead))
    # A run may reach over buckets: the first break of a later bucket ends it.
    firsts = rows.groupBy(*keys, "__b").agg(F.min(breaks).alias("__first"), F.max("__p").alias("__last"))
    later = Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    firsts = firsts.select(*own, F.col("__b").alias("__kb"), F.min("__first").over(later).alias("__later"), F.max("__last").over(Window.partitionBy(*keys)).alias("__all"))
    met = F.col("__b") == F.col("__kb")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(firsts, met).withColumn("__open", F.coalesce("__next", "__later").isNull())
    return out.withColumn("__e", F.coalesce(F.col("__next"), F.col("__later"), F.col("__all") + 1) - 1).where("__is").drop(*[f"__k{i}" for i in range(len(keys))])


def runs(events: DataFrame, q: PatternQuery, variable: str, every_end: bool = False, per_bucket: int = PER_BUCKET, ended: bool = False) -> DataFrame:
    """A struct column ``variable`` of first, last and count for each start row.

    The longest run of each start, or with ``every_end`` each shorter one too;
    with ``ended``, only of runs that a later row ends.  A reluctant run is its
    first row alone: the gap that follows takes the rest.
    """
    cols = q.carried(variable)
    row = F.struct(*cols)
    if q.variable(variable).quantifier != PLUS:
        alone = events.alias(variable).where(condition(q.independent(variable))).select(row.alias("r"))
        return alone.select(F.struct(F.col("r").alias("first"), F.col("r").alias("last"), F.lit(1).cast("long").alias("count")).alias(variable))
    rows = run_ends(events, q, variable, per_bucket)
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(q.partition_by)]
    names = [f"__k{i}" for i in range(len(keys))]
    ends = F.explode(F.sequence("__p", "__e")) if every_end else F.col("__e")
    starts = (rows.where("not __open") if ended else rows).select(*keys, F.col("__p"), ends.alias("__to"), row.alias("__first"))
    lasts = rows.select(*keys, F.col("__p").alias("__to"), row.alias("__last"))
    met = starts.join(lasts, [*names, "__to"])
    return met.select(F.struct(F.col("__first").alias("first"), F.col("__last").alias("last"), (F.col("__to") - F.col("__p") + 1).alias("count")).alias(variable))


def needs_every_end(q: PatternQuery, variable: str) -> bool:
    """Whether a later variable may lie inside the run, so that the longest run may not be the one that matches."""
    g, at = Graph(q), q.positions[variable]
    return any(not g.disjoint(variable, v) for v in q.names[at + 1 :])
