"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units run over a text's bytes, one from either end; a
softmax of both states labels every byte position.  A document's probability
of a language is the mean over all of its positions.

Texts are run in windows of ``WINDOW`` positions, many at a time.  Each window is
read from ``WARM`` bytes before it and from ``WARM`` bytes behind it, so the state
is carried through words and white space and is warm where a position is
labelled; the states forget so fast that the labels are those of one pass over
the whole text but for a small difference (a test bounds it).

The network is trained here, in numpy, by backpropagation through time over
stretches of ``STRETCH`` bytes (what chooses documents never holds more than 64 times
their number of a language in one task), from at most ``DOCS_PER_LANG`` documents of each
language (chosen by a hash of the id) and at most ``BYTES_PER_LANG`` of their
bytes.

Defined results: ``und`` with score 0 for a null text, for one without a letter
and where nothing could be learned; rows without an id are labelled and never
learned from; repeated rows give repeated results; of the columns asked for,
those named lang_pred or score (case aside) give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, map_texts, ship, slices, small_batches

ship(__name__)

HIDDEN = 8
WINDOW, WARM, STRETCH = 256, 32, 64
DOCS_PER_LANG, BYTES_PER_LANG, BYTES_PER_DOC = 200, 150_000, 20_000
AT_ONCE = 2048
SLICE_BYTES = 2_000_000


def stretches(data: bytes, size: int = STRETCH) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights: for each direction W (256, 3H), U (H, 3H), b (3H) in the order update, reset, candidate; V (2H, L) and c (L)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.p[f"U{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
            self.p[f"b{d}"] = np.zeros(3 * hidden)
        self.p["V"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, len(langs)))
        self.p["c"] = np.zeros(len(langs))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pass_over(self, x: np.ndarray, d: str, keep: bool = False):
        """The states (T, B, H) of one direction over bytes x (T, B), and what backpropagation needs."""
        h, (t, b) = self.h, x.shape
        w, u = self.p[f"W{d}"] + self.p[f"b{d}"], self.p[f"U{d}"]
        states, tape = np.zeros((t, b, h), np.float32), []
        s = np.zeros((b, h), np.float32)
        for k in range(t):
            a, r = w[x[k]], s @ u
            gates = sigmoid(a[:, : 2 * h] + r[:, : 2 * h])
            z, reset = gates[:, :h], gates[:, h:]
            n = np.tanh(a[:, 2 * h :] + reset * r[:, 2 * h :])
            if keep:
                tape.append((s, z, reset, n, r[:, 2 * h :]))
            s = n + z * (s - n)
            states[k] = s
        return states, tape

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, L) of each position."""
        both = np.concatenate([self.pass_over(x, "f")[0], self.pass_over(x[::-1], "b")[0][::-1]], axis=2)
        e = np.exp(both @ self.p["V"] + self.p["c"])
        return e / e.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of sequences x (T, B) with labels y (B), and its gradients."""
        h, (t, b) = self.h, x.shape
        runs = {"f": x, "b": x[::-1]}
        kept = {d: self.pass_over(v, d, keep=True) for d, v in runs.items()}
        both = np.concatenate([kept["f"][0], kept["b"][0][::-1]], axis=2)
        logits = both @ self.p["V"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        loss = -np.log(prob[:, np.arange(b), y] + 1e-9).mean()
        d_out = prob.copy()
        d_out[:, np.arange(b), y] -= 1
        d_out /= t * b
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        places = np.arange(3 * h)
        g["V"] = np.einsum("tbh,tbl->hl", both, d_out)
        g["c"] = d_out.sum((0, 1))
        d_both = d_out @ self.p["V"].T
        for d, run in runs.items():
            u = self.p[f"U{d}"]
            d_states = d_both[:, :, :h] if d == "f" else d_both[::-1, :, h:]
            ds, every = np.zeros((b, h), np.float32), np.zeros((t, b, 3 * h))
            for k in range(t - 1, -1, -1):
                s, z, reset, n, rn = kept[d][1][k]
                ds = ds + d_states[k]
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (s - n) * z * (1 - z)
                dr = dn * rn * reset * (1 - reset)
                da = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * reset], axis=1)
                every[k] = da
                g[f"U{d}"] += s.T @ du
                ds = ds * z + du @ u.T
            g[f"b{d}"] += every.sum((0, 1))
            at = (run.astype(np.int64)[:, :, None] * (3 * h) + places).ravel()
            g[f"W{d}"] += np.bincount(at, every.ravel(), 256 * 3 * h).reshape(256, 3 * h)
        return float(loss), g


def fit(samples: dict[str, list[str]], epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 0, most: int = BYTES_PER_LANG) -> Network | None:
    """Train on texts by language; sequences of one length share a batch, so none is padded."""
    rng = np.random.default_rng(seed)
    langs = sorted(samples)
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for y, lang in enumerate(langs):
        own = [p for t in samples[lang] for p in stretches(t.encode())]
        order = rng.permutation(len(own))
        ends = np.cumsum([len(own[k]) for k in order]) if own else np.zeros(0)
        for k in order[: int(np.searchsorted(ends, most))]:
            by_length.setdefault(len(own[k]), []).append((own[k], y))
    if not by_length:
        return None
    net = Network(langs, seed=seed)
    batches = []
    for own in by_length.values():
        order = rng.permutation(len(own))
        for i in range(0, len(own), batch):
            part = [own[k] for k in order[i : i + batch]]
            batches.append((np.array([np.frombuffer(p, np.uint8) for p, _ in part]).T, np.array([y for _, y in part])))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    step, total = 0, epochs * len(batches)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            _, g = net.gradients(*batches[k])
            step += 1
            for name in net.p:
                m[name] += 0.1 * (g[name] - m[name])
                v[name] += 0.001 * (g[name] ** 2 - v[name])
                net.p[name] -= (rate * (1 - step / total) + 1e-4) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return net


def windows(texts: list[bytes], size: int = WINDOW, warm: int = WARM) -> np.ndarray:
    """(text, first byte read, first labelled, end of the labelled, end of the read) of each window, as places in the joined texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n = -(-sizes // size)
    text = np.repeat(np.arange(len(texts)), n)
    lo = (ends - sizes)[text] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
    hi = np.minimum(lo + size, ends[text])
    return np.stack([text, np.maximum(lo - warm, (ends - sizes)[text]), lo, hi, np.minimum(hi + warm, ends[text])])


def pool(net: Network, texts: list[bytes], size: int = WINDOW, warm: int = WARM) -> np.ndarray:
    """Mean probabilities (texts, languages) over all positions; zeros where a text has none."""
    out = np.zeros((len(texts), len(net.langs)))
    found = windows(texts, size, warm)
    if not found.shape[1]:
        return out
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = found[:, np.argsort(found[4] - found[1], kind="stable")]  # windows of about one length together
    for i in range(0, found.shape[1], AT_ONCE):
        text, begin, lo, hi, end = found[:, i : i + AT_ONCE]
        length = end - begin
        step = np.arange(length.max())[:, None]
        behind = length - 1 - step  # the backward unit's step at each place, and the other way round
        last = len(data) - 1
        ahead = net.pass_over(data[np.minimum(begin + step, last)], "f")[0] @ net.p["V"][: net.h]
        back = net.pass_over(data[np.clip(begin + behind, 0, last)], "b")[0] @ net.p["V"][net.h :]
        e = np.exp(ahead + np.take_along_axis(back, np.maximum(behind, 0)[:, :, None], 0) + net.p["c"])
        e /= e.sum(axis=2, keepdims=True)
        e *= ((step >= lo - begin) & (step < hi - begin))[:, :, None]
        np.add.at(out, text, e.sum(0, dtype=np.float64))
    return out / np.maximum([len(t) for t in texts], 1)[:, None]


def sample(docs: DataFrame, most: int = DOCS_PER_LANG) -> dict[str, list[str]]:
    """At most ``most`` texts of each language, lowest hash of the id first, and the first ``BYTES_PER_DOC`` characters of each; rows without text, lang or id don't count.

    Of rows that repeat an id and language the least text counts.  The learner
    reads no more than ``BYTES_PER_LANG`` bytes of a language, which bounds what comes
    to the driver; the number of languages is that of distinct ``lang`` values.
    """
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # A hot language is cut to its lowest hashes in many parts before its rows meet.
    for by in ([F.col("lang"), F.pmod("h", F.lit(64))], [F.col("lang")]):
        rows = rows.withColumn("k", F.dense_rank().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("k") <= most).drop("k")
    chosen = bounded_broadcast(rows.select("doc_id", "lang").distinct(), 200_000)  # at most `most` rows a language
    texts = docs.where("text is not null").select("doc_id", F.substring("text", 1, BYTES_PER_DOC).alias("text"), "lang").join(chosen, ["doc_id", "lang"])
    out: dict[str, dict[int, str]] = {}
    for r in texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect():
        out.setdefault(r.lang, {})[r.doc_id] = r.text
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def predict(docs: DataFrame, net: Network | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: the given columns, lang_pred and score."""
    small_batches(docs.sparkSession)
    weights, langs, hidden = (net.p, net.langs, net.h) if net else ({}, [], 0)

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Network(langs, hidden) if langs else None
        if own:
            own.p = weights
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf.pop("__text")]
            known = np.array([bool(langs) and any(map(str.isalpha, t)) for t in texts])
            data, best, score = [t.encode() for t in texts], np.zeros(len(texts), int), np.zeros(len(texts))
            for i, j in slices([len(t) for t in data], SLICE_BYTES) if langs else ():
                p = pool(own, data[i:j])
                best[i:j], score[i:j] = p.argmax(1), p.max(1)
            pdf["lang_pred"] = [langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            pdf["score"] = np.where(known, np.clip(score, 0, 1), 0.0)
            yield pdf

    return map_texts(docs, columns, "lang_pred string, score double", op)
