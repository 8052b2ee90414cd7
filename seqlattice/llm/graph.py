"""Connected components by alternating large and small stars, in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], int(r["h"])


def components(links: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, label) of each node of the undirected ``links``; label is the least node of its component.

    Links are compared by their least neighbours only, so a hub costs what its
    links cost.  Null ends and loops are passed over.
    """
    real = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    shared_dir(links.sparkSession)
    # Not eager: the next action, which reads the state, also writes the checkpoint.
    edges = real.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint(eager=False)
    state = _state(edges)
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint(eager=False)
        if (now := _state(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
