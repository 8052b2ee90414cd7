"""Quality rules: plain counts, and a hashed n-gram likelihood ratio against the corpus.

Two multinomials over hashed byte n-grams are counted: one of the trusted
target, one of the raw corpus (every document).  A document's score is the mean
over its n-grams of ``log p_target - log p_raw``; the mean makes long and short
texts comparable.  A document passes if its score reaches a fixed threshold and
the base rules don't reject it, so every document gets the same verdict in
every run.

The hash has ``2 ** BITS`` buckets, so both multinomials are vectors of fixed
size whatever the corpus holds; each task sends its counts once.

Defined results: a null text counts as empty; a text without an n-gram scores
0; without any trusted text no document fails the ratio; repeated rows count
as often as they occur; a row without an id is never trusted; of the columns
asked for, those with a result's name (case aside) give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, map_texts, ship, slices, small_batches

ship(__name__)

N, BITS = 4, 16
THRESHOLD = -0.3
SYMBOLS = "#*$%&|<>"
SLICE_BYTES = 2_000_000


def buckets(texts: list[bytes], n: int = N, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of the texts in order, and how many n-grams each text has."""
    sizes = np.array([max(0, len(t) - n + 1) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    if len(joined) < n:
        return np.zeros(0, np.int32), sizes
    h = np.zeros(len(joined) - n + 1, np.uint32)
    for k in range(n):
        h = (h ^ joined[k : len(joined) - n + 1 + k]) * np.uint32(0x01000193)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)
    if len(texts) > 1:  # n-grams that reach into the next text don't count
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        keep = np.ones(len(h), bool)
        for back in range(1, n):
            at = ends[:-1] - back
            at = at[(at >= 0) & (at < len(h))]
            keep[at] = False
        h = h[keep]
    return h.astype(np.int32), sizes


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    words = text.encode().split()  # splits at exactly 0x20 and 0x09-0x0D
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    repeated = 0
    if len(words) > 2:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        if len(number) < len(words):
            base = len(number)
            if base < 2_000_000:
                keys = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
            else:  # the product would not fit
                pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1].astype(np.int64)
                keys = pair[:-1] * base + ids[2:]
            order = np.argsort(keys, kind="stable")
            ks = keys[order]
            same = ks[1:] == ks[:-1]
            twice = np.zeros(len(keys), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeated = int(covered.sum())
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), dup, repeated


def count_ngrams(docs: DataFrame, trusted: DataFrame, n: int = N, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the trusted target and of the raw corpus, over all rows of ``docs``.

    ``trusted`` has the doc_id of each trusted document once.
    """
    small_batches(docs.sparkSession)
    marked = docs.select("doc_id", "text").join(bounded_broadcast(trusted.select("doc_id", F.lit(True).alias("__good"))), "doc_id", "left")
    marked = marked.select("text", F.coalesce("__good", F.lit(False)).alias("__good"))

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((2, 1 << bits), np.int64)
        for pdf in batches:
            for good, part in pdf.groupby("__good"):
                texts = [t.encode() for t in part["text"] if t is not None]
                for i, j in slices([len(t) for t in texts], SLICE_BYTES):
                    c = np.bincount(buckets(texts[i:j], n, bits)[0], minlength=1 << bits)
                    both[0] += c
                    if good:
                        both[1] += c
        at = np.flatnonzero(both[0])
        yield pd.DataFrame({"bucket": at, "raw": both[0][at], "target": both[1][at]})

    rows = marked.mapInPandas(op, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # 2 ** bits rows at most
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 2.0) -> np.ndarray:
    """Per bucket. Pseudo-counts are as large a share of either corpus, so buckets too rare to judge stay near 0."""
    if target.sum() == 0:
        return np.zeros(len(raw), np.float32)
    p, q = target + smooth, raw + smooth * raw.sum() / target.sum()
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


def score(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, columns: tuple[str, ...] = ("doc_id",), n: int = N) -> DataFrame:
    """One row for each row of ``docs``: the given columns, the counts, base_failed, kept and the score (``llr``)."""
    small_batches(docs.sparkSession)
    bits = len(ratio).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf.pop("__text")]
            for k, values in zip(counts, zip(*map(base_features, texts), strict=True), strict=False):
                pdf[k] = values
            data, mean = [t.encode() for t in texts], np.zeros(len(texts))
            for i, j in slices([len(t) for t in data], SLICE_BYTES):
                at, sizes = buckets(data[i:j], n, bits)
                ends = np.concatenate([[0], np.cumsum(table[at], dtype=np.float64)])
                upto = np.concatenate([[0], np.cumsum(sizes)])
                mean[i:j] = (ends[upto[1:]] - ends[upto[:-1]]) / np.maximum(sizes, 1)
            pdf["base_failed"] = (pdf["n_words"] < 50) | (100 * pdf["n_repeat_words"] > 50 * pdf["n_words"])
            pdf["kept"] = ~pdf["base_failed"] & (mean >= threshold)
            pdf["llr"] = mean
            yield pdf

    return map_texts(docs, columns, f"{', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean, llr double", op)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The trusted target: documents labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def rules(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, log_ratio(*count_ngrams(docs, trusted_ids(labels))), threshold, columns)
