"""Line dedup: a line goes if an earlier line equals it up to one edit.

Lines are the pieces between line feeds; their order is (doc_id, position).  A
line that is not blank is removed if an earlier line, in any document, equals
it.  A line of at least ``LEAST`` characters is also removed if an earlier line of
at least as many is within Levenshtein distance 1 of it (a character put in,
taken out or changed): in shorter lines one edit often makes another word.
Lines are judged on the input, not on what is left.  Blank lines stay.

The method is a deletion-neighbourhood join, and everything in it is a
grouped minimum, so no group is ever paired with itself:

* Equal lines: the earliest of each hash.
* Distinct lines that differ by a change at place i have the same text without
  their i-th character, so all lines that share (this text's hash, i) are
  within one edit of each other, and of the group's earliest.
* If a line is another one without one character, the hash of the one is a
  deletion variant of the other: the earliest of either side is enough.

Emitting each deletion of each line would multiply the input by a line's
length.  An edit falls into one of ``PARTS`` parts of a line and leaves the
rest as it is, so first the hashes of "all but this part" are grouped: only
lines that share one with a different line, and only the places within that
part, emit variants.  This loses no pair.  A found pair's distance is verified
with ``levenshtein`` before the later line goes.

Defined results: a null text has no lines and stays null; an empty text has one
empty line; a null id comes first; rows that repeat an id share their positions,
so equal lines at one position don't remove each other, and each such row loses
only lines that it has itself; columns of any name are kept, but for those that
n_lines and n_removed replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, beside, bounded_broadcast, cut, quoted

LEAST = 20
PARTS = 8
BROADCAST_ROWS = 500_000
TELL = 1 << 24


def place(doc_id: Column, pos: Column, h: Column) -> Column:
    """A number for a line: its order (doc_id, position), and behind that some bits of its hash to tell lines of rows that repeat an id apart."""
    at = (F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(18,0)")).cast("decimal(30,0)") + pos
    return (at.cast("decimal(30,0)") * F.lit(TELL).cast("decimal(8,0)")).cast("decimal(38,0)") + F.pmod(h, F.lit(TELL))


def earlier(a: str, b: str) -> Column:
    """Whether the place of number ``a`` comes before that of ``b``."""
    order = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(TELL).cast("decimal(8,0)"))
    return order(a) < order(b)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, n, h, g, at) of each line that isn't blank; h and g are two hashes."""
    split = docs.select(F.col("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("n", F.char_length("line")).where(F.col("line").rlike(NOT_SPACE))
    return split.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), F.col("line"))}).withColumn("at", place(F.col("doc_id"), F.col("pos"), F.col("h")))


def part_keys(line: Column, n: Column, base: Column, parts: int, role: int) -> Column:
    """For each part j of a line cut as one of ``base`` characters is: the hash of all but part j, and its bounds."""
    edge = lambda j: F.floor(base * j / parts).cast("int")

    def key(j: Column) -> Column:
        head, tail = edge(j), base - edge(j + 1)
        return F.struct(F.xxhash64(base, j, F.substring(line, F.lit(1), head), F.substring(line, n - tail + 1, tail)).alias("key"), head.alias("lo"), (base - tail).alias("hi"), F.lit(role).alias("long"))

    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), key)


def near_parts(line: Column, n: Column, parts: int) -> Column:
    """The keys of a line as one of n characters, and as one that has a character more than the other."""
    return F.concat(part_keys(line, n, n, parts, 0), part_keys(line, n, n - 1, parts, 1))


def suspects(lines: DataFrame, id_: str, parts: int, keep: list[str]) -> DataFrame:
    """Lines (by ``id_``) that share a part key with a different one, with the key's bounds."""
    keyed = lines.select(id_, *keep, F.explode(near_parts(F.col("line"), F.col("n"), parts)).alias("k")).select(id_, *keep, "k.*")
    shared = keyed.groupBy("key").agg(F.min(id_).alias("__lo"), F.max(id_).alias("__hi")).where("__lo < __hi").select("key")
    return keyed.join(shared, "key")


def removed_lines(docs: DataFrame, least: int = LEAST, parts: int = PARTS) -> DataFrame:
    """(doc_id, pos, h) of each line that goes, once."""
    lines = lines_of(docs)
    # Halves first, on hashes alone; the few lines that share one are then looked at closely.
    half = F.when(F.col("n") >= least, near_parts(F.col("line"), F.col("n"), 2))
    hashed = lines.select("h", "g", "at", half.alias("half")).select("h", "g", "at", *[F.col("half")[k]["key"].alias(f"k{k}") for k in range(4)])
    distinct = cut(hashed.groupBy("h", "g").agg(F.min("at").alias("first"), F.count("*").alias("times"), *[F.first(f"k{k}").alias(f"k{k}") for k in range(4)]))
    keyed = distinct.where("k0 is not null").select("h", "g", "first", F.explode(F.array_distinct(F.array(*[f"k{k}" for k in range(4)]))).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("first").alias("__lo"), F.max("first").alias("__hi")).where("__lo < __hi").select("key")
    close = cut(keyed.join(shared, "key").select("h", "g", "first").distinct())
    few = bounded_broadcast(close.select(F.col("h"), F.col("g"), F.col("first").alias("at")), BROADCAST_ROWS)
    texts = cut(lines.select("line", "n", "h", "g", "at").join(few, ["h", "g", "at"]).dropDuplicates(["at"]))

    hits = suspects(texts, "at", parts, []).groupBy("at", "lo", "hi", "long").agg(F.lit(1).alias("one")).drop("one")
    variants = texts.join(hits, "at")
    without = lambda i: F.concat(F.substring("line", F.lit(1), i), F.substring(F.col("line"), i + 2, F.col("n")))
    # Changed characters lie at lo..hi-1; a longer line's extra character lies at lo..hi.
    upto = F.least(F.col("n") - 1, F.col("hi") - 1 + F.col("long"))
    keys = F.when(F.col("lo") <= upto, F.transform(F.sequence(F.col("lo"), upto), lambda i: F.struct(F.xxhash64(without(i)).alias("v"), F.when(F.col("long") == 0, i).alias("i")))).otherwise(F.array().cast("array<struct<v:bigint,i:int>>"))
    variants = cut(variants.select("at", "n", F.explode(keys).alias("k")).select("at", F.col("k.v").alias("v"), F.col("k.i").alias("i"), "n").distinct())
    changed = variants.where("i is not null")
    first = changed.groupBy("v", "i").agg(F.min("at").alias("to"), F.max("at").alias("__last")).where(F.col("to") < F.col("__last"))
    pairs = changed.join(first, ["v", "i"]).where(earlier("to", "at")).select("at", "to")
    longer = variants.where("i is null").select("at", "v")
    whole = texts.select(F.col("at").alias("short"), F.col("h").alias("v"))
    met = longer.groupBy("v").agg(F.min("at").alias("__first")).join(whole, "v")
    pairs = pairs.unionByName(longer.join(met, "v").where(earlier("short", "at")).select("at", F.col("short").alias("to")))
    pairs = pairs.unionByName(met.where(earlier("__first", "short")).select(F.col("short").alias("at"), F.col("__first").alias("to")))
    a, b = texts.select("at", "h", "g", "line"), texts.select(F.col("at").alias("to"), F.col("line").alias("other"))
    near = pairs.distinct().join(a, "at").join(b, "to").where(F.levenshtein("line", "other", 1).between(0, 1)).select("h", "g").distinct()

    marks = distinct.join(near.withColumn("near", F.lit(True)), ["h", "g"], "left").where("times > 1 or near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    marks = cut(marks)
    return lines.select("doc_id", "pos", "h", "g", "at").join(bounded_broadcast(marks, BROADCAST_ROWS), ["h", "g"]).where("near or at > first").select("doc_id", "pos", "h").distinct()


def mark(pos: Column, h: Column) -> Column:
    """A line of a document by its position and 32 bits of its hash."""
    return F.shiftleft(pos.cast("long"), 32).bitwiseOR(h.bitwiseAND(F.lit(0xFFFFFFFF)))


def dedup(docs: DataFrame, least: int = LEAST, parts: int = PARTS) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts, and n_lines and n_removed."""
    removed = removed_lines(docs, least, parts)
    gone = removed.groupBy("doc_id").agg(F.collect_list(mark(F.col("pos"), F.col("h"))).alias("__gone")).select(F.col("doc_id").alias("__id"), "__gone")
    gone = cut(gone)
    size = gone.agg(F.coalesce(F.sum(F.size("__gone")), F.lit(0)).alias("n")).first()["n"]
    own = docs.select(F.struct(*quoted(docs.columns)).alias("__row"), F.col("doc_id").alias("__of"), F.split("text", "\n", -1).alias("__lines"))
    met = own.join(bounded_broadcast(gone, BROADCAST_ROWS) if size <= 4 * BROADCAST_ROWS else gone, F.col("__of").eqNullSafe(F.col("__id")), "left")
    marks = F.transform("__lines", lambda line, i: mark(i, F.xxhash64(line)))
    met = met.withColumn("__stay", F.when(F.col("__gone").isNotNull(), F.array_except(marks, F.col("__gone"))))
    text = F.when(F.col("__stay").isNull(), F.col("__row.text")).otherwise(F.array_join(F.transform("__stay", lambda m: F.get("__lines", F.shiftright(m, 32).cast("int"))), "\n"))
    rest = [F.col(f"__row.{quoted([c])[0]}").alias(c) if c.lower() != "text" else text.alias(c) for c in beside(docs.columns, "n_lines", "n_removed")]
    n = F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long")
    return met.select(*rest, n.alias("n_lines"), F.when(F.col("__stay").isNull(), 0).otherwise(F.size("__lines") - F.size("__stay")).cast("long").alias("n_removed"))
