"""Post-processing by another run of the pattern: over the rows that composed candidates use, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..pattern.model import PatternQuery
from .compose import answer
from .scan import scan


def used_rows(events: DataFrame, q: PatternQuery, composed: DataFrame) -> DataFrame:
    """The events that some candidate holds, each once for each variable as which it is held (``__as``), looked up by id and time."""
    held = None
    for v in q.names:
        own = composed.select(F.lit(v).alias("__as"), F.col(f"{v}.{q.id_column}").alias("__id"), F.col(f"{v}.{q.ts_column}").alias("__ts")).distinct()
        held = own if held is None else held.unionByName(own)
    return events.join(held, (F.col(q.id_column) == F.col("__id")) & (F.col(q.ts_column) == F.col("__ts"))).drop("__id", "__ts")


def rerun(events: DataFrame, q: PatternQuery, composed: DataFrame) -> DataFrame:
    """The query's answer from the rows that candidates use: the best match of a start row uses no other.

    Rows between are gone, so runs of consecutive rows can't be told: a query
    with a run is refused.
    """
    if q.kleene:
        raise ValueError("a run's rows must be consecutive in the whole stream")
    rows = used_rows(events, q, composed)
    return answer(q, {frozenset([v]): scan(rows.where(F.col("__as") == v), q, v) for v in q.names})
