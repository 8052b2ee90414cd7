"""Synthetic event streams, drawn on the executors by arithmetic on the row number."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILES = ("grid", "uniform", "high_match", "clustered", "bursty")
#: Origin and extent of the coordinates. Fixed values.
ORIGIN, EXTENT = (-87.90, 41.60), (0.20, 0.20)
OTHER = "OTHER"


@dataclass(frozen=True)
class Config:
    rows: int
    types: dict[str, float] = field(default_factory=lambda: {f"T{k}": 0.05 for k in range(1, 9)})
    profile: str = "uniform"
    seed: int = 42
    rate: float = 1000.0  # events a second
    start: str = "2024-01-01 00:00:00"
    clusters: int = 1
    cluster_share: float = 0.0
    cluster_width: float = 0.02
    key_values: int = 0  # values of the balanced key; 0: no key
    burst_every: int = 1000
    burst_share: float = 0.5


def exact_counts(c: Config) -> dict[str, int]:
    """Rows of each type by largest remainder; what is left is OTHER."""
    if sum(c.types.values()) > 1 + 1e-9:
        raise ValueError("shares sum to more than 1")
    shares = c.types | {OTHER: max(0.0, 1 - sum(c.types.values()))}
    out = {t: math.floor(s * c.rows) for t, s in shares.items()}
    by_rest = sorted(shares, key=lambda t: (-(shares[t] * c.rows - out[t]), t))
    for t in by_rest[: c.rows - sum(out.values())]:
        out[t] += 1
    return out


def shuffled(n: int, seed: int) -> Column:
    """A permutation of 0 .. n-1 of the row's ``k``: exact shares without a sort."""
    step = next(s for s in range(int(n * 0.6180339887) + 2 * seed + 1, 10**18) if math.gcd(s, n) == 1) % n or 1
    return F.pmod(F.col("k") * F.lit(step) + F.lit(seed), F.lit(n))


def uniform(c: Config, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(c.seed), F.lit(salt), F.col("k")), F.lit(1 << 53)) / F.lit(float(1 << 53))


def coordinate(c: Config, axis: int) -> Column:
    lo, length = ORIGIN[axis], EXTENT[axis]
    if c.profile == "grid":
        side = max(1, math.isqrt(c.rows))
        cell = F.pmod(F.col("k"), F.lit(side)) if axis == 0 else F.pmod(F.floor(F.col("k") / side), F.lit(side))
        return F.lit(lo) + (cell + 0.5) * F.lit(length / side)
    plain = F.lit(lo) + uniform(c, 10 + axis) * length
    share = {"high_match": 0.9, "clustered": c.cluster_share or 0.6}.get(c.profile, c.cluster_share)
    if not share:
        return plain
    count = max(1, c.clusters if c.profile != "high_match" else 1)
    which = F.floor(uniform(c, 12) * count)
    centre = F.pmod(F.xxhash64(F.lit(c.seed), F.lit(20 + axis), which), F.lit(1000)) / 1000.0 * (length - c.cluster_width)
    return F.when(uniform(c, 13) < share, F.lit(lo) + centre + uniform(c, 14 + axis) * c.cluster_width).otherwise(plain)


def micros(c: Config) -> Column:
    """Strictly increasing times: even, or with a share of each stretch crowded at its end."""
    gap = max(2, round(1e6 / c.rate))
    even = F.col("k") * gap
    if c.profile != "bursty":
        return even
    inside, stretch = F.pmod(F.col("k"), F.lit(c.burst_every)), F.floor(F.col("k") / c.burst_every)
    calm = round(c.burst_every * (1 - c.burst_share))
    wide = (c.burst_every * gap - (c.burst_every - calm) * (gap // 2)) // max(1, calm)
    at = F.when(inside < calm, inside * wide).otherwise(calm * wide + (inside - calm) * max(1, gap // 2))
    return stretch * (c.burst_every * gap) + at


def events(spark: SparkSession, c: Config) -> DataFrame:
    """id (from 1 on), ts, time, primary_type, lon, lat and, if asked for, ekey."""
    if c.profile not in PROFILES:
        raise ValueError(f"profiles are {', '.join(PROFILES)}")
    ends, total, kind = exact_counts(c), 0, None
    rank = shuffled(c.rows, c.seed)
    for t, n in ends.items():
        total += n
        kind = F.when(rank < total, t) if kind is None else kind.when(rank < total, t)
    ts = F.timestamp_add("MICROSECOND", micros(c).cast("long"), F.expr(f"TIMESTAMP_NTZ'{c.start}'"))
    cols = [(F.col("k") + 1).alias("id"), ts.alias("ts"), ts.alias("time"), kind.alias("primary_type"), coordinate(c, 0).alias("lon"), coordinate(c, 1).alias("lat")]
    if c.key_values:
        cols.append(F.pmod(shuffled(c.rows, c.seed + 7), F.lit(c.key_values)).alias("ekey"))
    return spark.range(c.rows).select(F.col("id").alias("k")).select(*cols)


def width_for(sigma: float, length: float) -> float:
    """The half-width d of a band whose two uniform draws over ``length`` meet with chance sigma: 2r - r*r = sigma, r = d/length."""
    if not 0 < sigma <= 1:
        raise ValueError("sigma is between 0 and 1")
    return length * (1 - math.sqrt(1 - sigma))


def boxes(c: Config, axis: int) -> list[tuple[float, float, float]]:
    """(share, low, high) of the uniform parts that the coordinate is drawn from."""
    lo, length = ORIGIN[axis], EXTENT[axis]
    share = {"high_match": 0.9, "clustered": c.cluster_share or 0.6}.get(c.profile, c.cluster_share) if c.profile != "grid" else 0.0
    count = max(1, c.clusters if c.profile != "high_match" else 1)
    return [(1 - share, lo, lo + length), *((share / count, lo + (at := centre_of(c, axis, k)), lo + at + c.cluster_width) for k in range(count) if share)]


def centre_of(c: Config, axis: int, k: int) -> float:
    """Where a cluster begins, as :func:`coordinate` places it: Spark's chained xxhash64 of the seed, the axis and the cluster."""
    import xxhash

    h = 42
    for value, kind in ((c.seed, "<i" if -(1 << 31) <= c.seed < 1 << 31 else "<q"), (20 + axis, "<i"), (k, "<q")):
        h = xxhash.xxh64_intdigest(struct.pack(kind, value), seed=h)
    signed = h - (1 << 64) if h >> 63 else h
    return signed % 1000 / 1000.0 * (EXTENT[axis] - c.cluster_width)


def within(a: tuple[float, float], b: tuple[float, float], d: float) -> float:
    """The chance that uniform draws from two intervals differ by at most d: the share of the rectangle that lies in the strip."""
    def below(t: float) -> float:  # chance of x - y <= t, by the areas of cut-off corners
        corner = lambda z: max(0.0, z) ** 2 / 2
        (p, q), (r, s) = a, b
        area = corner(t + s - p) - corner(t + s - q) - corner(t + r - p) + corner(t + r - q)
        return area / ((q - p) * (s - r))

    return below(d) - below(-d)


def pair_share(parts: list[tuple[float, float, float]], d: float) -> float:
    """The chance that two draws of a mixture of uniform parts differ by at most d."""
    return sum(u * v * within((a, b), (p, q), d) for u, a, b in parts for v, p, q in parts)


def calibrated_width(c: Config, sigma: float, axis: int = 0) -> float:
    """The half-width of a band on one coordinate whose selectivity is sigma under the profile's mixture, by bisection of the closed form."""
    if not 0 < sigma <= 1:
        raise ValueError("sigma is between 0 and 1")
    parts, lo, hi = boxes(c, axis), 0.0, EXTENT[axis]
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if pair_share(parts, mid) < sigma else (lo, mid)
    return hi


def expected_pairs(c: Config, a: str, b: str, sigma: float) -> float:
    n = exact_counts(c)
    return n[a] * n[b] * sigma


def feasible(c: Config, edges: list[tuple[str, str, float]], floor: float = 100.0) -> list[str]:
    """Edges of which too few pairs are expected."""
    return [f"{a}-{b}" for a, b, s in edges if expected_pairs(c, a, b, s) < floor]
