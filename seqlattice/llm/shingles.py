"""Hashes of words and of word shingles, vectorised over many texts at once."""

from __future__ import annotations

import numpy as np

from .common import ship

ship(__name__)

WORDS = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base, np.uint64))]).astype(np.uint64)[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (parted by 0x20, 0x09-0x0D) of the texts in order, and how many words each text has."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    length = end - start
    inside = np.flatnonzero(~blank)
    where = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    value = (joined[inside].astype(np.uint64) + np.uint64(1)) * powers(0x100000001B3, int(length.max()))[where]
    hashes = mixed(np.add.reduceat(value, np.cumsum(length) - length) ^ length.astype(np.uint64))
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.diff(np.searchsorted(start, first))


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text the hashes of its runs of ``words`` words, in order; of all its words if it has fewer."""
    h, counts = word_hashes(texts)
    factor = powers(0xD6E8FEB86659FD93, words)
    n = max(0, len(h) - words + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(words):
        runs += h[k : k + n] * factor[k]
    runs = mixed(runs)
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            out.append(runs[at : at + c - words + 1])
        elif c:
            out.append(mixed((h[at : at + c] * factor[:c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
