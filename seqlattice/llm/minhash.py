"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its runs of five words.  A shingle weighs its
number of occurrences times ``1 + ln(N / df) / ln(N)``, between 1 and 2 for
each; its document frequency df is the true one, counted over all documents
(``frequencies.py``).  Improved consistent weighted sampling draws ``SAMPLES``
shingles so that two texts agree on each with a probability equal to their
weighted Jaccard similarity.  ``BANDS`` bands of three samples name buckets:
at a similarity of 0.8 a pair misses all of them once in about 45,000.

Equal texts are one node from the start.  No bucket is paired with itself:

1. Each member is compared with the bucket's least node; verified pairs give
   classes (connected components).
2. Nodes of buckets that still hold more than one class go to finer buckets.  A
   pair of similarity t shares one of the rarest shingles that hold a share
   1 - t of either text's weight, so the shingles of this prefix that another
   document holds name them.  What only one document holds names none, so texts
   too different to be linked mostly meet in no finer bucket.
3. Nodes that meet are dealt into cells of about ``CELL``.  Two cells with a finer
   bucket in common are compared as a whole, as a product of two matrices in
   one task, and return links between different classes, as many as join them.
   A node goes to cells and not to pairs, so rows grow with the nodes of a dense
   group times its cells, though the comparisons grow with the square.

A pair is left unverified only where it cannot reach the threshold: a sketch
holds a set's weight in each of ``PLACES`` places, rounded up, and two sets share
no more of a place than the lesser of both.  No estimate decides, so a pair of
any bucket that reaches the threshold ends in one class.  A pair counts if the
exact weighted Jaccard similarity of the two weighted sets reaches the
threshold.  The result is a class for each row, the least id of its members.

Defined results: a null text is in a class of its own row's id; texts without
a word are alike only if equal; a text of fewer than five words is one shingle;
a null id never names a class unless all its members' ids are null; repeated
rows share a class; of the columns asked for, those named class_id or class_size
(case aside) give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, bounded_broadcast, cut, few_rows, many_small_steps, quoted, release, ship, small_batches
from .frequencies import counted, framed, pack, unpack
from .graph import components
from .shingles import mixed, powers

ship(__name__)

BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
THRESHOLD = 0.8
PLACES = 184
CELL = 256
PAIRS = 2000
TOGETHER = 60_000


def gamma_distribution() -> tuple[np.ndarray, np.ndarray]:
    """Points of the distribution of Gamma(2, 1): (share below, value)."""
    x = np.concatenate([np.geomspace(1e-7, 0.1, 20_000), np.linspace(0.1, 30, 60_000)[1:]])
    return -np.expm1(-x) - x * np.exp(-x), x


class GammaTables:
    """Quantiles of Gamma(2, 1) at the middles of 2 ** 16 equal steps, and finer ones."""

    def __init__(self):
        self.curve = gamma_distribution()
        every = np.interp((np.arange(65536) + 0.5) / 65536, *self.curve)
        self.value, self.inverse, self.log = every.astype(np.float32), (1 / every).astype(np.float32), np.log(every).astype(np.float32)


def sample_sets(features: np.ndarray, weights: np.ndarray, starts: np.ndarray, samples: int = SAMPLES, tables: GammaTables | None = None) -> np.ndarray:
    """Improved consistent weighted sampling of the sets that begin at ``starts``: (sets, samples) of uint32.

    A 64-bit word for each feature and sample gives its two Gamma variables (16
    bits each, and for the smallest values, which decide in large sets, 16 more)
    and its uniform one.
    """
    tables = tables or GammaTables()
    key, log_w = mixed(features), np.log(weights).astype(np.float32)
    high, odd = (key >> np.uint64(32)).astype(np.uint32), powers(0x5851F42D4C957F2D, samples + 1)[1:]
    out, x, shifted = np.zeros((len(starts), samples), np.uint32), np.empty(len(key), np.uint64), np.empty(len(key), np.uint64)
    ranked = np.empty(len(key), np.uint64)
    halves = ranked.view(np.uint32).reshape(-1, 2)
    for k in range(samples):
        np.multiply(key ^ odd[-1 - k], odd[k], out=x)
        np.right_shift(x, np.uint64(32), out=shifted)
        np.bitwise_xor(x, shifted, out=x)
        np.multiply(x, np.uint64(0x94D049BB133111EB), out=x)
        np.right_shift(x, np.uint64(29), out=shifted)
        np.bitwise_xor(x, shifted, out=x)
        bits = x.view(np.uint16).reshape(-1, 4)
        of_r, of_c = bits[:, 3].astype(np.intp), bits[:, 1].astype(np.intp)
        beta, log_c = bits[:, 2] * np.float32(2.0**-16), tables.log.take(of_c)
        small = np.flatnonzero(of_c < 256)
        log_c[small] = np.log(np.interp((of_c[small] + (bits[small, 0] + 0.5) / 65536) / 65536, *tables.curve))
        t = np.floor(log_w * tables.inverse.take(of_r) + beta)
        a = (log_c - tables.value.take(of_r) * (t - beta + np.float32(1))).view(np.int32)
        # Floats in the order of their bits, with what names the sample behind.
        halves[:, 1] = (a ^ ((a >> np.int32(31)) | np.int32(-(1 << 31)))).view(np.uint32)
        halves[:, 0] = high ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        out[:, k] = np.minimum.reduceat(ranked, starts).astype(np.uint32)
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) of int64."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        h = mixed(h ^ parts[:, :, k]) + np.uint64(k)
    return h.view(np.int64)


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log(np.maximum(n, 1) / np.clip(df, 1, max(n, 1))) / max(np.log(max(n, 2)), 1e-9)).astype(np.float32)


class Packed:
    """A sorted weighted set in few bytes: the first 40 bits of each shingle, how often it occurs, and in how many documents."""

    def __init__(self, data: bytes, n: int):
        f, self.times, self.df = unpack(data, "<u8", "<u4", "<u4")
        self.shingles, self.each = f << np.uint64(24), inverse_frequencies(self.df, n)
        self.weights = self.times * self.each
        self.weight = float(self.weights.sum(dtype=np.float64))

    @staticmethod
    def of(shingles: np.ndarray, times: np.ndarray, df: np.ndarray) -> bytes:
        first, at = np.unique(shingles >> np.uint64(24), return_index=True)
        return pack(first.astype("<u8"), np.add.reduceat(times, at).astype("<u4") if len(at) else times.astype("<u4"), df[at].astype("<u4"))

    def similarity(self, other: Packed) -> float:
        """Weighted Jaccard similarity."""
        _, i, j = np.intersect1d(self.shingles, other.shingles, assume_unique=True, return_indices=True)
        both = float(np.minimum(self.weights[i], other.weights[j]).sum(dtype=np.float64))
        return both / (self.weight + other.weight - both or 1.0)

    def levels(self) -> np.ndarray:
        """A number for each occurrence: two sets share as many of a shingle's as the lesser of both has."""
        total = int(self.times.sum())
        nth = np.arange(total) - np.repeat(np.cumsum(self.times) - self.times, self.times)
        return np.repeat(self.shingles, self.times) | nth.astype(np.uint64)

    def prefix(self, threshold: float) -> np.ndarray:
        """The rarest shingles, as many as hold a share 1 - threshold of the weight, and one more; of these, those that other documents hold too."""
        order = np.lexsort((self.shingles, self.df))
        held = np.cumsum(self.weights[order], dtype=np.float64)
        k = int(np.searchsorted(held, (1 - threshold) * held[-1] * (1 + 1e-6), side="right")) + 1
        chosen = order[:k]
        return self.shingles[chosen[self.df[chosen] > 1]]


def shared_weights(a: list[Packed], b: list[Packed], columns: int = 4096) -> np.ndarray:
    """The weight that each set of ``a`` shares with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    own = [[x.levels() for x in side] for side in (a, b)]
    both = np.intersect1d(np.concatenate(own[0]), np.concatenate(own[1]))
    for lo in range(0, len(both), columns):
        part, dense = both[lo : lo + columns], []
        for side, levels in zip((a, b), own, strict=True):
            m = np.zeros((len(side), len(part)), np.float32)
            for k, (x, level) in enumerate(zip(side, levels, strict=True)):
                at = np.searchsorted(part, level)
                hit = np.flatnonzero(part[np.minimum(at, len(part) - 1)] == level)
                m[k, at[hit]] = np.repeat(x.each, x.times)[hit] if side is a else 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def joining(a: list[Packed], b: list[Packed], labels_a: list[str], labels_b: list[str], threshold: float) -> Iterator[tuple[int, int, float]]:
    """(place in a, place in b, similarity) of pairs of different labels that reach the threshold, as many as join the labels."""
    shared = shared_weights(a, b)
    near = shared / (np.array([x.weight for x in a])[:, None] + np.array([x.weight for x in b])[None, :] - shared)
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while x in parent:
            x = parent[x]
        return x

    for i, j in np.argwhere(near >= threshold - 1e-3).tolist():
        u, v = find(labels_a[i]), find(labels_b[j])
        if u != v and (similarity := a[i].similarity(b[j])) >= threshold:
            parent[max(u, v)] = min(u, v)
            yield i, j, similarity


def sketch(shingles: np.ndarray, weights: np.ndarray) -> bytes:
    """The weight of a set, a step, and the set's weight in each place as that many steps, rounded up; a place follows from the bits that packed sets keep."""
    held = np.bincount(((shingles >> np.uint64(24)) % np.uint64(PLACES)).astype(np.int64), weights, PLACES)
    step = np.float32(held.max() / 255 * (1 + 1e-6))
    return np.array([held.sum(), step], np.float32).tobytes() + np.ceil(held / step).clip(0, 255).astype(np.uint8).tobytes()


def unsketch(sketches: list[bytes] | pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(weights, weights in each place) of sketches."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), 8 + PLACES)
    head = np.ascontiguousarray(rows[:, :8]).view(np.float32)
    return head[:, 0], rows[:, 8:] * head[:, 1:]


def possible(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Whether sets of these weights can reach the threshold: never false where they do."""
    both = np.minimum(np.minimum(a[1], b[1]).sum(1), np.minimum(a[0], b[0]))
    return both >= threshold * (1 - 1e-4) * (a[0] + b[0] - both)


class Finder:
    """The links between the distinct texts of ``docs``."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD):
        small_batches(docs.sparkSession)
        self.threshold = threshold
        self.frame, self.n = framed(docs.where("text is not null").select(F.md5("text").alias("node"), "text"))

    def signatures(self) -> DataFrame:
        """(node, block, bands, sketch) of each distinct text with a word."""
        n = self.n

        def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables = GammaTables()

            def signed(held: list, block: int) -> pd.DataFrame:
                sizes = np.array([len(f) for _, f, _ in held])
                got = sample_sets(np.concatenate([f for _, f, _ in held]), np.concatenate([w for _, _, w in held]), np.cumsum(sizes) - sizes, tables=tables)
                return pd.DataFrame({"node": [x for x, _, _ in held], "block": block, "bands": list(band_keys(got)), "sketch": [sketch(f, w) for _, f, w in held]})

            for pdf in batches:
                for block, data, back in zip(pdf["block"], pdf["data"], pdf["back"], strict=True):
                    held, size = [], 0
                    for node, f, times, df in counted(data, back):
                        if len(f):
                            held.append((node, f, times * inverse_frequencies(df, n)))
                            size += len(f)
                        if size > TOGETHER:
                            yield signed(held, block)
                            held, size = [], 0
                    if held:
                        yield signed(held, block)
            release()

        rows = self.frame.mapInPandas(op, "node string, block long, bands array<long>, sketch binary")
        return rows.groupBy("node").agg(F.first(F.struct("block", "bands", "sketch")).alias("x")).select("node", "x.*")

    def vectors(self, nodes: DataFrame) -> DataFrame:
        """(node, packed) of the given nodes (node, block)."""
        wanted = cut(nodes.groupBy("block").agg(F.collect_list("node").alias("wanted")))

        def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for data, back, wanted in zip(pdf["data"], pdf["back"], pdf["wanted"], strict=True):
                    own = set(wanted)
                    some = [(node, Packed.of(f, times, df)) for node, f, times, df in counted(data, back) if node in own]
                    yield pd.DataFrame(some, columns=["node", "packed"])
            release()

        with few_rows(nodes.sparkSession):
            return cut(self.frame.join(bounded_broadcast(wanted, 5_000), "block").mapInPandas(op, "node string, packed binary"))

    def verified(self, pairs: DataFrame, vectors: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose weighted Jaccard similarity reaches the threshold, with it.

        Pairs of one ``a`` go together, by at most about ``PAIRS``: a node that leads many is sent once for each such part.
        """
        threshold, n = self.threshold, self.n
        pairs = cut(pairs)
        hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).alias("parts")).where("parts > 1")
        groups = max(1, pairs.count() // PAIRS)
        part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
        placed = cut(pairs.select("a", "b").join(bounded_broadcast(hot, 200_000), "a", "left").select(F.pmod(F.xxhash64("a", part), F.lit(groups)).alias("k"), "a", "b"))
        sent = placed.select("k", F.col("a").alias("node")).union(placed.select("k", "b")).distinct().join(vectors, "node").select(F.col("k").alias("part"), "node", "packed")

        def op(some: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
            held = {x: Packed(p, n) for x, p in zip(sets["node"], sets["packed"], strict=True)}
            out = [(a, b, held[a].similarity(held[b])) for a, b in zip(some["a"], some["b"], strict=True)]
            return pd.DataFrame([x for x in out if x[2] >= threshold], columns=["a", "b", "similarity"])

        return cut(placed.groupBy("k").cogroup(sent.groupBy("part")).applyInPandas(op, "a string, b string, similarity double"))

    def to_leaders(self, buckets: DataFrame, own: DataFrame) -> DataFrame:
        """(a, b): each member of a bucket with the bucket's least node, where their sketches allow a link."""
        threshold = self.threshold
        least = buckets.groupBy("key").agg(F.min("node").alias("a"))
        met = buckets.join(least, "key").where("a < node").select("a", F.col("node").alias("b")).distinct()
        for x in "ab":
            met = met.join(own.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")), x)

        def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.loc[possible(unsketch(pdf["sketch_a"]), unsketch(pdf["sketch_b"]), threshold), ["a", "b"]]

        return met.mapInPandas(op, "a string, b string")

    def finer(self, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
        """(key, node, label): finer buckets, by the shingles of prefixes, that hold several labels."""
        threshold, n = self.threshold, self.n

        def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    yield pd.DataFrame({"key": Packed(r.packed, n).prefix(threshold).view(np.int64), "node": r.node, "label": r.label})

        keys = cut(vectors.join(nodes, "node").mapInPandas(op, "key long, node string, label string"))
        several = keys.groupBy("key").agg(F.min("label").alias("__lo"), F.max("label").alias("__hi"), F.min("node").alias("least")).where("__lo < __hi").select("key", "least")
        return cut(keys.join(several, "key"))

    def across(self, finer: DataFrame, vectors: DataFrame) -> DataFrame:
        """Links that join classes which meet in a finer bucket."""
        threshold, n = self.threshold, self.n
        home = finer.groupBy("node").agg(F.min("least").alias("home"), F.first("label").alias("label"))
        hot = home.groupBy("home").agg(F.ceil(F.count("*") / CELL).alias("parts")).where("parts > 1")
        cell = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))
        cells = cut(home.join(bounded_broadcast(hot, 200_000), "home", "left").select("node", "label", cell.alias("cell")))
        met = finer.select("key", "node").join(cells.select("node", "cell"), "node").select("key", "cell").distinct()
        # A cell meets itself wherever it holds several nodes; cells that meet alone in a bucket make one pair.
        pairs = met.select("key", F.col("cell").alias("x")).join(met.select("key", F.col("cell").alias("y")), "key").where("x <= y").select("x", "y").distinct()
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
        pairs = cut(pairs.join(sizes.select(F.col("cell").alias("x"), "n"), "x").where("x < y or n > 1").select("x", "y"))
        groups = max(1, pairs.count() // 4)
        ends = pairs.select("x", "y", F.col("x").alias("cell")).union(pairs.where("x < y").select("x", "y", "y"))
        sent = ends.join(cells, "cell").join(vectors, "node").select(F.pmod(F.xxhash64("x", "y"), F.lit(groups)).alias("k"), "x", "y", F.col("cell") == F.col("x"), "node", "label", "packed").toDF("k", "x", "y", "first", "node", "label", "packed")

        def op(pdf: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[str, str, float]] = []
            for (x, y), some in pdf.groupby(["x", "y"]):
                sides = [some[some["first"]], some if x == y else some[~some["first"]]]
                sets = [[Packed(p, n) for p in side["packed"]] for side in sides]
                names, labels = [side["node"].tolist() for side in sides], [side["label"].tolist() for side in sides]
                out += [(names[0][i], names[1][j], s) for i, j, s in joining(*sets, *labels, threshold)]
            return pd.DataFrame(out, columns=["a", "b", "similarity"])

        return cut(sent.groupBy("k").applyInPandas(op, "a string, b string, similarity double"))

    def links(self) -> DataFrame:
        """Links that give the classes: (a, b, similarity)."""
        with few_rows(self.frame.sparkSession):
            signed = cut(self.signatures())
        every = signed.select("node", F.explode("bands").alias("key"))
        shared = every.groupBy("key").agg(F.min("node").alias("__lo"), F.max("node").alias("__hi")).where("__lo < __hi").select("key")
        buckets = cut(every.join(shared, "key").select("key", "node"))
        own = cut(signed.join(buckets.select("node").distinct(), "node").select("node", "block", "sketch"))
        vectors = self.vectors(own)
        found = self.verified(self.to_leaders(buckets, own), vectors)
        marked = buckets.join(components(found, "a", "b"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        several = marked.groupBy("key").agg(F.min("label").alias("__lo"), F.max("label").alias("__hi")).where("__lo < __hi").select("key")
        rest = cut(marked.join(several, "key").select("node", "label").distinct())
        return found.unionByName(self.across(self.finer(rest, vectors), vectors))


def classed(docs: DataFrame, names: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Each row of ``docs`` as a struct ``row`` of the named columns, with its id, class_id, class_size and, in classes of several rows, label."""
    with many_small_steps(docs.sparkSession):
        labels = cut(components(Finder(docs, threshold).links(), "a", "b"))
    ids = docs.where("text is not null").groupBy(F.md5("text").alias("node")).agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    marked = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = marked.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    # Only texts that are alone need no entry: equal texts and classes do.
    classes = cut(marked.join(per, "label").where("class_size > 1").select(F.col("node").alias("__node"), "class_id", "class_size", "label"))
    own = docs.select(F.struct(*quoted(names)).alias("row"), F.col("doc_id").alias("id"), F.md5("text").alias("__of"))
    met = own.join(bounded_broadcast(classes, 500_000), F.col("__of") == F.col("__node"), "left")
    return met.select("row", "id", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "label")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: the given columns, class_id (least doc_id of the class) and class_size (its rows)."""
    return classed(docs, beside(list(columns), "class_id", "class_size"), threshold).select("row.*", "class_id", "class_size")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one of each class: that with the least id (any one of rows that repeat it, or where all lack an id); null texts stay."""
    rows = classed(docs, docs.columns, threshold)
    alone = F.col("label").isNull()
    return rows.where(alone).select("row.*").unionByName(rows.where(~alone & (F.col("class_id").isNull() | (F.col("id") == F.col("class_id")))).dropDuplicates(["label"]).select("row.*"))
