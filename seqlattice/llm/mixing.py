"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources share the total size by weight; a target stops at ``CAP`` times its
source's size, and what is over is shared again by weight (water-filling, in
closed form).  Each source is dealt into blocks by a hash of the id, about
``BLOCKS`` over all sources, so blocks grow with the corpus and their number
does not.  A source's mix is its permuted blocks, as many whole rounds as the
target holds, then whole blocks of one more round that fit, then documents that
fit out of the next ``CUT_BLOCKS`` blocks, so that one too large doesn't end the mix,
and the least one left if that comes nearer to the target.

The draws of blocks are partitioned exactly among output shards: a tree halves
the shards, and at each node the left half's share of every source is drawn
from the multivariate hypergeometric distribution (one source after another,
by inversion of the exact distribution with a hash as the uniform number).
Each shard then takes disjoint consecutive runs of each source's permuted
draws, and orders its documents by a hash: the local shuffle.  Everything is a
function of ids and the seed, so reruns agree.

Only DataFrame functions run.  Documents are never shuffled by source: they
meet a table of blocks, whose size is bounded and checked.  Windows by source hold
a source's blocks (``CELLS`` at most) or the documents of its ``CUT_BLOCKS`` cut
blocks, so a hot source is no large task.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; an empty table gives an empty mix; rows that repeat an id are
drawn together, each with its own size, and so are all rows without an id; a column of ``docs`` with the name of a
result gives way to it in :func:`mix`, and :func:`mixed_rows` returns the columns
of ``docs`` as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, beside, bounded_broadcast, cut, many_small_steps, quoted

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCKS = 4096
CELLS = 4096
SHARDS = 64
PASSES = 5
CUT_BLOCKS = 16
SEED = 17


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z >= 1: Stirling's series six steps further on."""
    y = z + 6
    steps = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) - F.log(steps)


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items from ``total`` are among the ``good``, by inversion at u."""

    def draw(p: Column) -> Column:
        ln = lambda k: -log_gamma((k + 1).cast("double")) - log_gamma((p["good"] - k + 1).cast("double")) - log_gamma((p["drawn"] - k + 1).cast("double")) - log_gamma((p["total"] - p["good"] - p["drawn"] + k + 1).cast("double"))
        lo, hi = F.greatest(F.lit(0).cast("long"), p["drawn"] - (p["total"] - p["good"])), F.least(p["good"], p["drawn"])
        return let(F.transform(F.sequence(lo, hi), ln), lambda w: let(F.array_max(w), lambda top: let(F.transform(w, lambda x: F.exp(x - top)), lambda e: at(lo, e, p["u"]))))

    def at(lo: Column, weights: Column, u: Column) -> Column:
        start = F.struct((u * F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)).alias("left"), lo.alias("k"))
        step = lambda a, x: F.struct((a["left"] - x).alias("left"), (a["k"] + F.when(a["left"] >= x, 1).otherwise(0)).alias("k"))
        # Once the mass is used up, what is left is negative and stays so.
        return F.aggregate(weights, start, step, lambda a: F.least(a["k"], lo + F.size(weights) - 1))

    return let(F.struct(total.alias("total"), good.alias("good"), drawn.alias("drawn"), u.alias("u")), draw)


def split(quotas: Column, drawn: Column, *key: Column) -> Column:
    """The left half's quotas: ``drawn`` of all draws, one source after another."""
    whole = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(whole.alias("total"), drawn.alias("drawn"), F.array().cast("array<long>").alias("out"))

    def one(a: Column, i: Column) -> Column:
        good = F.element_at(quotas, i)
        return let(hypergeometric(a["total"], good, a["drawn"], uniform(*key, i)), lambda x: F.struct((a["total"] - good).alias("total"), (a["drawn"] - x).alias("drawn"), F.concat(a["out"], F.array(x)).alias("out")))

    return F.aggregate(F.transform(quotas, lambda _, k: k + 1), start, one, lambda a: a["out"])


def tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, quotas) of each leaf, from one row with the array ``quotas``."""
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("leaves"), "quotas")
    for level in range((shards - 1).bit_length()):
        left = F.col("leaves") - F.expr("leaves div 2")
        drawn = F.expr("cast((leaves - leaves div 2) * aggregate(quotas, 0L, (a, x) -> a + x) / leaves as long)")
        nodes = nodes.withColumn("left", F.when(F.col("leaves") == 1, F.col("quotas")).otherwise(split(F.col("quotas"), drawn, F.lit(seed), F.lit(level), F.col("shard"))))
        nodes = nodes.select(
            F.explode(
                F.when(F.col("leaves") == 1, F.array(F.struct("shard", "leaves", "quotas"))).otherwise(
                    F.array(
                        F.struct("shard", left.alias("leaves"), F.col("left").alias("quotas")),
                        F.struct((F.col("shard") + left).alias("shard"), F.expr("leaves div 2").alias("leaves"), F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas")),
                    )
                )
            ).alias("n")
        ).select("n.*")
    return nodes.select("shard", "quotas")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds i (place in order of code points, null last), weight and target to one row for each source with its size.

    One row for each source meets in one task: sources are few next to documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("i", F.row_number().over(every)).withColumn("weight", F.element_at(cycle, (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("size") / F.col("weight"), "i")
    s = s.withColumn("__before", F.coalesce(F.sum("size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap)
    s = s.withColumn("__weights", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    free = Window.partitionBy()
    s = s.withColumn("__all", F.sum("size").over(free)).withColumn("__level", (F.col("__all") - F.col("__before")) / F.col("__weights")).withColumn("__level", F.max("__level").over(free))
    return s.select("source", "size", "i", "weight", F.least(F.col("size") * float(cap), F.col("weight") * F.col("__level")).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """One row for each block of each source: source, block, rank, source_size, target, rounds, shards (of each draw) and, if the last draw takes it in part, the passes of ``fill``."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = cut(docs.select("source", F.pmod(key, F.lit(CELLS)).alias("cell"), F.xxhash64(F.lit(seed + 1), F.col("doc_id")).alias("h"), words().alias("size")))
    cells = cut(sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))  # CELLS rows a source at most
    # From here on tables have a row for each source or block: one task holds them, and nothing is exchanged.
    # Each is cut where several others read it: the driver would plan it anew for each of them.
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    with many_small_steps(docs.sparkSession):
        sources = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("size")).coalesce(1), weights, cap)
        count = F.greatest(F.lit(1), F.ceil(F.col("size") * F.lit(blocks) / F.greatest(F.sum("size").over(Window.partitionBy()), F.lit(1))))
        sources = sources.withColumn("n", F.least(count, F.lit(CELLS)).cast("long"))
        sources = cut(sources.withColumn("rounds", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")).withColumn("rest", F.col("target") - F.col("rounds") * F.col("size")))
        of = cells.alias("a").join(bounded_broadcast(sources).alias("b"), same).select("b.*", "a.cell", "a.cell_size", F.expr(f"a.cell * b.n div {CELLS}").alias("block"))
        parts = of.groupBy("source", "i", "size", "target", "n", "rounds", "rest", "block").agg(F.sum("cell_size").alias("words")).coalesce(1)
        order = Window.partitionBy("i").orderBy(F.xxhash64(F.lit(seed + 2), "i", "block"), "block")
        parts = fill(parts.withColumn("rank", F.row_number().over(order) - 1).withColumnRenamed("rest", "room"), ["i"], "rank", "words").drop("passes")
        left = Window.partitionBy("i", "taken").orderBy("rank")
        parts = parts.withColumn("cut", ~F.col("taken") & (F.col("room") > 0) & (F.row_number().over(left) <= CUT_BLOCKS))
        parts = cut(parts.withColumn("draws", F.col("rounds") + F.when(F.col("taken") | F.col("cut"), 1).otherwise(0)))
        # Exact quotas of block draws, split among the shards.
        every = parts.groupBy("i").agg(F.sum("draws").alias("q")).agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("l")).select(F.transform("l", lambda x: x["q"]).alias("quotas"))
        leaves = tree(every, shards, seed).select("shard", F.posexplode("quotas").alias("j", "q"))
        ends = leaves.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("shard", "q"))).alias("l"))
        ends = cut(ends.select((F.col("j") + 1).alias("i"), F.transform(F.sequence(F.lit(1), F.size("l")), lambda k: F.aggregate(F.slice("l", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x["q"])).alias("ends")))
        blocked = parts.join(bounded_broadcast(ends), "i")
        # Draw r of the block with rank k is number r * n + k; blocks without documents hold no number.
        live = Window.partitionBy("i")
        blocked = blocked.withColumn("m", F.count("*").over(live))
        shard_of = lambda number: F.size(F.filter("ends", lambda e: e <= number))
        blocked = cut(blocked.withColumn("shards", F.when(F.col("draws") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1), lambda r: shard_of(r * F.col("m") + F.col("rank")))).otherwise(F.array().cast("array<int>"))).drop("ends"))
    # Documents of the blocks that the last draw takes in part.
    split_ = blocked.where("cut").select("source", "i", "block", "n", "rank", "room")
    inside = cut(sized.alias("a").join(bounded_broadcast(split_).alias("b"), same & (F.expr(f"a.cell * b.n div {CELLS}") == F.col("b.block"))).select("b.i", "a.size", "b.room", F.struct("b.rank", "a.h").alias("at")))
    with many_small_steps(docs.sparkSession):
        last = cut(fill(inside, ["i"], "at", "size", round_up=True).groupBy("i").agg(F.first("passes").alias("last")))
        out = blocked.join(bounded_broadcast(last), "i", "left")
        return cut(out.select("source", "block", "n", "rank", F.col("size").alias("source_size"), "target", "rounds", "cut", "shards", "last"))


def fill(rows: DataFrame, by: list[str], order: str, size: str, round_up: bool = False) -> DataFrame:
    """Takes rows into each group's ``room``: in order up to the first that doesn't fit, then, of those that fit into what is left, again; ``PASSES`` times.

    With ``round_up``, the least row left goes too if that comes nearer to the room.
    Adds ``taken`` and ``passes``, an array of (most, first, last): a row is taken if in
    one of these its size is at most ``most`` and its place from first to last.
    ``room`` becomes what is left.  Rows of one place and size go together.
    """
    upto, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    lowest = F.min(order).over(whole).alias("first")
    rows = rows.withColumn("taken", F.lit(False)).withColumn("room", F.col("room").cast("double"))
    for k in range(PASSES):
        rows = rows.withColumn("__fits", ~F.col("taken") & (F.col(size) <= F.col("room")))
        rows = rows.withColumn("__now", F.col("__fits") & (F.sum(F.when(F.col("__fits"), F.col(size))).over(upto) <= F.col("room")))
        rows = rows.withColumn(f"__pass{k}", F.struct(F.col("room").alias("most"), lowest, F.max(F.when(F.col("__now"), F.col(order))).over(whole).alias("last")))
        rows = rows.withColumn("room", F.col("room") - F.coalesce(F.sum(F.when(F.col("__now"), F.col(size))).over(whole), F.lit(0))).withColumn("taken", F.col("taken") | F.col("__now"))
    names = [f"__pass{k}" for k in range(PASSES)]
    if round_up:
        near = F.when(~F.col("taken") & (F.col(size) < 2 * F.col("room")), F.struct(F.col(size).cast("double").alias("most"), F.col(order).alias("first"), F.col(order).alias("last")))
        rows, names = rows.withColumn("__up", F.min(near).over(whole)), [*names, "__up"]
    return rows.withColumn("passes", F.filter(F.array(*names), lambda p: p["last"].isNotNull())).drop("__fits", "__now", *names)


def placed(docs: DataFrame, names: list[str], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """Each row of ``docs`` as a struct ``row`` of the named columns, with size, source_size, target and shards."""
    if missing := {"doc_id", "source", "text"} - set(docs.columns):
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    table = plan(docs, weights, cap, shards, blocks, seed)
    table = table.select(*[F.col(c).alias(f"__{c}") for c in table.columns])
    own = docs.select(F.struct(*quoted(names)).alias("row"), F.col("source").alias("__from"), words().alias("size"), F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(CELLS)).alias("__cell"), F.xxhash64(F.lit(seed + 1), F.col("doc_id")).alias("__h"))
    met = own.join(bounded_broadcast(table), F.col("__from").eqNullSafe(F.col("__source")) & (F.expr(f"__cell * __n div {CELLS}") == F.col("__block")))
    at = F.struct(F.col("__rank").alias("rank"), F.col("__h").alias("h"))
    in_cut = F.exists(F.col("__last"), lambda p: (F.col("size") <= p["most"]) & at.between(p["first"], p["last"]))
    cut_off = F.col("__cut") & ~F.coalesce(in_cut, F.lit(False))
    taken = F.when(cut_off, F.slice("__shards", F.lit(1), F.col("__rounds").cast("int"))).otherwise(F.col("__shards"))
    return met.select("row", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("shards"))


def mix(docs: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """One row for each row of ``docs``: its columns (or ``keep``), size, source_size, target and ``shards``, the shard of each time it is taken."""
    names = beside(docs.columns if keep is None else keep, "size", "source_size", "target", "shards")
    return placed(docs, names, **options).select("row.*", "size", "source_size", "target", "shards")


def mixed_rows(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, once for each time a row is taken, dealt by shard and shuffled within."""
    rows = placed(docs, docs.columns, seed=seed, shards=shards, **options).select("row", F.posexplode("shards").alias("time", "shard"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed + 3), "shard", "row.doc_id", "time"))
    return rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "order").select("row.*")
