"""Ranges of about as many rows each, however the order's values are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled places for each range.
PER_RANGE = 32
MOST = 4096


def splitters(df: DataFrame, order: list[str], per_range: int, rows: int | None = None) -> list[tuple]:
    """Places (one value for each order column) that cut ``df`` into ranges of about ``per_range`` rows.

    They are quantiles of a sample that a hash of the place picks, so they are
    the same in every run; all columns count, so ties in the first one are cut
    too.  Rows of one place stay together.  At most ``MOST`` ranges, and
    ``PER_RANGE`` sampled places for each on the driver.
    """
    rows = df.count() if rows is None else rows
    parts = min(MOST, rows // max(1, per_range))
    if parts < 2:
        return []
    place = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    every = max(1, rows // (parts * PER_RANGE))
    sample = df.select(place.alias("place")).where(F.pmod(F.xxhash64("place"), F.lit(every)) == 0)
    found = sample.agg(F.sort_array(F.collect_list("place")).alias("all")).select(
        F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda k: F.get("all", F.floor(k * F.size("all") / parts).cast("int"))).alias("cuts")
    ).first()["cuts"]
    out: list[tuple] = []
    for cut in found or []:
        if cut is not None and (not out or tuple(cut) != out[-1]):
            out.append(tuple(cut))
    return out


def range_of(cuts: list[tuple], values: list[Column]) -> Column:
    """How many of the places are at most the row's, by bisection."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.struct(*[F.lit(v).alias(f"o{k}") for k, v in enumerate(cut)]) for cut in cuts])
    own = F.struct(*[v.alias(f"o{k}") for k, v in enumerate(values)])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        open_ = s["lo"] < s["hi"]
        below = open_ & (F.get(table, mid) <= own)
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve, lambda s: s["lo"])
