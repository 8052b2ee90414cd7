"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

A section ends after a run of two or more line feeds, a paragraph after a line
feed, a leaf after ``LEAF`` characters of its paragraph.  The cuts keep every
character, so equal roots mean equal texts (up to collisions of SHA-256).  A
leaf's digest is the start of its SHA-256; the digest of a paragraph, section
or root is the SHA-256 of its level's letter and its children's digests.

The fingerprint is a string, ``root:leaves``: sections are parted by ``|``,
paragraphs by ``/`` and leaves by ``.``.  Two fingerprints are alike by the
Dice coefficient of their distinct leaves; :func:`edits` names the paragraphs
whose branches differ.

Only DataFrame functions run.  Defined results: a null text counts as empty; an
empty text has a root and no leaf; two fingerprints without leaves are alike
to 1, one without leaves and one with leaves to 0; rows that repeat an id are
neighbours in the order of their texts; a null id comes first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAF = 64
DIGEST = 12
PER_BUCKET = 256
BUCKETS = 32768
SECTION = r"(?s).+?(?:\n{2,}|\z)"
PARAGRAPH = r"[^\n]*\n|[^\n]+"


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def tree(text: Column, leaf: int = LEAF) -> Column:
    """Sections of paragraphs of leaf digests."""
    take = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.transform(take(text, SECTION), lambda s: F.transform(take(s, PARAGRAPH), lambda p: F.transform(take(p, f"(?s).{{1,{leaf}}}"), lambda x: F.substring(sha(x), 1, DIGEST))))


def root(branches: Column) -> Column:
    """The root's digest of a tree of leaf digests."""
    level = lambda name, digests: sha(F.concat(F.lit(name), F.array_join(digests, "")))
    return level("R", F.transform(branches, lambda s: level("S", F.transform(s, lambda p: level("P", p)))))


def render(branches: Column) -> Column:
    leaves = F.array_join(F.transform(branches, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(p, ".")), "/")), "|")
    return F.concat(root(branches), F.lit(":"), leaves)


def fingerprint(text: Column, leaf: int = LEAF) -> Column:
    return render(tree(F.coalesce(text, F.lit("")), leaf))


def leaves_of(print_: Column) -> Column:
    """The distinct leaf digests that a fingerprint holds."""
    return F.array_distinct(F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit(r"[^./|]+"), F.lit(0)))


def alike(a: Column, b: Column) -> Column:
    """Likeness of two arrays of distinct leaves, 0 to 1."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def edits(a: Column, b: Column) -> Column:
    """Numbers (from 0, over the whole text) of the paragraphs of fingerprint ``a`` whose branches ``b`` lacks."""
    of = lambda x: F.split(F.substring_index(x, ":", -1), r"[/|]")
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<int>")).otherwise(
        F.filter(F.transform(of(a), lambda p, i: F.when(~F.array_contains(of(b), p), i)), lambda i: i.isNotNull())
    )


def place_in(splitters: list[int], value: Column) -> Column:
    """How many of the sorted splitters are at most the value, by bisection."""
    if not splitters:
        return F.lit(0)
    table = F.lit(np.array(splitters, np.int64))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = (s["lo"] < s["hi"]) & (F.get(table, mid) <= value)
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(splitters).bit_length())), start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(doc_id, text, next): the text of the next document in order of doc_id, of the last one the first's.

    Ids are dealt into about ``per_bucket`` a bucket (but at most ``BUCKETS``
    buckets) at their quantiles, however they are spread.  Within a bucket a
    window finds the neighbour; the first row of each bucket is also sent to the
    bucket before, and that of the first to the last.  Rows that share an id, and
    those without one, meet in one bucket, in the order of their texts.
    """
    n = docs.count()
    parts = min(BUCKETS, max(1, n // per_bucket))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / parts for k in range(1, parts)] or [0.5], 10 * BUCKETS).alias("q")).first()["q"]
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(place_in(sorted(set(cuts or [])) if parts > 1 else [], F.col("doc_id").cast("long"))).cast("long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bucket.alias("b"))
    firsts = rows.groupBy("b").agg(F.min("doc_id").alias("first"))
    by = Window.orderBy("b")  # a row for each bucket, BUCKETS + 1 at most
    before = F.coalesce(F.lag("b").over(by), F.max("b").over(Window.partitionBy()))
    firsts = cut(firsts.coalesce(1).select("b", "first", before.alias("to"), F.lag("b").over(by).isNull().alias("wraps")))
    met = rows.join(F.broadcast(firsts), "b")
    sent = F.array(F.struct(F.col("b").alias("to"), F.lit(0).alias("place")), F.struct("to", F.when(F.col("wraps"), 2).otherwise(1).alias("place")))
    lead = F.col("doc_id").eqNullSafe(F.col("first"))
    met = met.select("doc_id", "text", F.explode(F.when(lead, sent).otherwise(F.slice(sent, 1, 1))).alias("at")).select("doc_id", "text", "at.*")
    order = Window.partitionBy("to").orderBy("place", F.col("doc_id").asc_nulls_first(), "text")
    return met.withColumn("next", F.lead("text").over(order)).where("place = 0").select("doc_id", "text", "next")


def compare(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its likeness to that and to the next document's."""
    rows = with_next(docs.select("doc_id", "text"))
    n = F.char_length("text").cast("long")
    half = F.expr("cast(char_length(text) div 2 as int)")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next", F.lit(1), half))
    rows = rows.select("doc_id", n.alias("n_chars"), "text", "next", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", sha(F.col("edited")).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next")).alias("__next"))
    rows = rows.withColumns({"__a": leaves_of(F.col("fingerprint")), "__b": leaves_of(F.col("edited_fingerprint")), "__c": leaves_of(F.col("__next"))})
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike(F.col("__a"), F.col("__b")).alias("near_edited"), alike(F.col("__a"), F.col("__c")).alias("near_next"))
