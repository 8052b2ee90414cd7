"""Quality classifier by compression: how much better one dictionary fits than the other.

Two zstandard dictionaries are built from labelled texts, one of good and one
of bad documents.  A text is cut into blocks of ``BLOCK`` bytes, and each block
is compressed with either dictionary, so that the dictionary and not the text's
own past decides.  The difference of the two sums of sizes, divided by their
mean, is the normalised difference; a logistic curve fitted to training
documents turns it into a probability.  The curve also sees the size of the
blocks compressed without a dictionary relative to their length, since the
difference means less where a block compresses to almost nothing by itself.

Fitting takes at most ``DOCS_PER_CLASS`` documents of each class, lowest hash
of the id first (of rows that repeat an id the least text), the first
``CHARS_PER_DOC`` characters of each, and for dictionaries at most ``DICT_BYTES`` times
100 of their bytes; half of them build the dictionaries and the other half fit
the curve.  Scoring reads whole texts.

Defined results: null and empty texts score as the share of good documents in
the training rows; with fewer than ``LEAST`` documents of a class there is no
classifier and every text gets that share (0.5 without any label); an id with
both labels counts as bad; labels without an id and ids without a document are
passed over, and rows without an id are scored like others; repeated rows give
repeated results; of the columns asked for, those named score or predicted (case
aside) give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, map_texts, ship, small_batches

ship(__name__)

BLOCK = 512
DICT_BYTES = 64 * 1024
DOCS_PER_CLASS, CHARS_PER_DOC = 1500, 50_000
LEVEL = 3
LEAST = 8
CUT = 0.3


def blocks(data: bytes, size: int = BLOCK) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def build(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of the texts' blocks; their plain bytes where there are too few to train on."""
    import zstandard

    parts = [b for t in texts for b in blocks(t)]
    total, kept = 0, []
    for p in parts[:: max(1, len(parts) * BLOCK // (100 * size))]:
        total += len(p)
        kept.append(p)
    try:
        return zstandard.train_dictionary(size, kept, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(kept)[-size:]


class Sizes:
    """The two features of a text."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.pack = []
        for d in (good, bad, b""):
            options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if d:
                made = zstandard.ZstdCompressionDict(d)
                made.precompute_compress(level=LEVEL)
                options["dict_data"] = made
            self.pack.append(zstandard.ZstdCompressor(**options).compress)

    def features(self, data: bytes) -> tuple[float, float]:
        """(normalised difference: positive if the good dictionary fits better; own compressed share)."""
        parts = blocks(data)
        good, bad, plain = (sum(map(len, map(pack, parts))) for pack in self.pack)
        return 2 * (bad - good) / (bad + good), plain / len(data)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method with a small ridge; (mean, scale, weights with the intercept last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 0.5 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - 0.5 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def expand(f: np.ndarray) -> np.ndarray:
    d, s = f[:, 0], f[:, 1]
    return np.column_stack([d, s, d * s, s * s])


class Model:
    def __init__(self, share: float, good: bytes = b"", bad: bytes = b"", curve=None):
        self.share, self.good, self.bad, self.curve = share, good, bad, curve

    def score(self, sizes: Sizes | None, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.share)
        at = [k for k, t in enumerate(texts) if t]
        if self.curve is not None and at:
            mean, scale, w = self.curve
            x = (expand(np.array([sizes.features(texts[k]) for k in at])) - mean) / scale
            out[at] = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        return out


def fit(good: list[str], bad: list[str], share: float) -> Model:
    sides = [[t.encode() for t in x if t] for x in (good, bad)]
    if min(map(len, sides)) < LEAST:
        return Model(share)
    dicts = [build(x[::2]) for x in sides]
    sizes = Sizes(*dicts)
    rest = [x[1::2] for x in sides]
    f = np.array([sizes.features(t) for x in rest for t in x])
    y = np.array([1.0] * len(rest[0]) + [0.0] * len(rest[1]))
    return Model(share, *dicts, logistic(expand(f), y))


def sample(docs: DataFrame, labels: DataFrame, most: int = DOCS_PER_CLASS) -> tuple[list[str], list[str], float]:
    """(good texts, bad texts, share of good rows); ``labels`` holds the training rows only.

    An id with both labels counts as bad; ids without a document are passed over.
    """
    own = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r["n"] for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    texts: list[list[str]] = []
    for q in (1, 0):
        ids = own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
        rows = docs.where("text is not null").select("doc_id", F.substring("text", 1, CHARS_PER_DOC).alias("text")).join(bounded_broadcast(ids), "doc_id")
        texts.append([r.text for r in sorted(rows.groupBy("doc_id").agg(F.min("text").alias("text")).collect())])
    return texts[0], texts[1], share


def classify(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), cut: float = CUT) -> DataFrame:
    """One row for each row of ``docs``: the given columns, score and predicted."""
    small_batches(docs.sparkSession)
    parts = (model.share, model.good, model.bad, model.curve)

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*parts)
        sizes = Sizes(own.good, own.bad) if own.curve is not None else None
        for pdf in batches:
            pdf["score"] = own.score(sizes, [(t or "").encode() for t in pdf.pop("__text")])
            pdf["predicted"] = (pdf["score"] >= cut).astype("int32")
            yield pdf

    return map_texts(docs, columns, "score double, predicted int", op)
