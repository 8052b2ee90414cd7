"""True document frequencies of shingles, exchanged as sorted, delta-coded hashes.

Texts are gathered into blocks of about ``BLOCK_BYTES`` bytes, each one row.
A block sends its distinct shingles, sorted and cut into parts by their leading
bits, with the number of its documents that hold each; the sum over all blocks
is a shingle's frequency, and goes back to the blocks in the order in which
their shingles came.  So a shingle costs some six bytes one way, next to
nothing on the way back, and no frequency is estimated.  The number of parts
follows the number of shingles, so a part holds about ``PART`` of them however
large the corpus; a shingle that every document holds comes once from a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few_rows, release, ship
from .shingles import shingle_hashes

ship(__name__)

BLOCK_BYTES = 4_000_000
PART = 1_000_000
SLICE = 1_000_000


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as compressed byte planes."""
    import zstandard

    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + size * n].reshape(size, n).T).view(kind).ravel())
        at += size * n
    return out


def blocks(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """(block, data, docs, shingles): distinct texts of ``docs`` (node, text), packed with how often each occurs in the block."""

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        import zstandard
        from pyspark import TaskContext

        held: dict[str, list] = {}
        size, seq, first = 0, 0, TaskContext.get().partitionId() << 32

        def row() -> pd.DataFrame:
            texts = [x[0] for x in held.values()]
            words = [len(t.split()) for t in texts]
            times = [x[1] for x in held.values()]
            data = zstandard.ZstdCompressor(level=3).compress(pickle.dumps((list(held), times, texts)))
            return pd.DataFrame({"block": [first + seq], "data": [data], "docs": [sum(n for n, w in zip(times, words, strict=True) if w)], "shingles": [sum(max(w - 4, min(w, 1)) for w in words)]})

        for pdf in batches:
            for node, text in zip(pdf["node"], pdf["text"], strict=True):
                if node in held:
                    held[node][1] += 1
                    continue
                held[node] = [text.encode(), 1]
                size += len(held[node][0])
                if size >= limit:
                    yield row()
                    held, size, seq = {}, 0, seq + 1
        if held:
            yield row()

    return docs.select("node", "text").mapInPandas(op, "block long, data binary, docs long, shingles long")


def texts_of(data: bytes) -> tuple[list[str], list[int], list[bytes]]:
    """(nodes, times, texts) of a block."""
    import pickle

    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def sets_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingles, how often each occurs) of each text."""
    out, at, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or k == len(texts) - 1:
            out += [np.unique(s, return_counts=True) for s in shingle_hashes(texts[at : k + 1])]
            at, size = k + 1, 0
    return out


def ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the values, and where in it each distinct one begins."""
    order = np.argsort(values)
    held = values[order]
    return order, np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)


def part_of(shingles: np.ndarray, parts: int) -> np.ndarray:
    """Parts in the order of the shingles."""
    return ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def frequencies(held: DataFrame, parts: int) -> DataFrame:
    """(block, back): for each block the frequencies of its parts' shingles, packed, with the parts' numbers."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, data in zip(pdf["block"], pdf["data"], strict=True):
                _, times, texts = texts_of(data)
                sets = sets_of(texts)
                every = np.concatenate([f for f, _ in sets]) if sets else np.zeros(0, np.uint64)
                order, first = ordered(every)
                f, n = every[order[first]], np.repeat(times, [len(f) for f, _ in sets])[order]
                n = np.add.reduceat(n, first).astype("<u4") if len(f) else n
                own = part_of(f, parts)
                at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(f) else np.zeros(0, int)
                sent = [pack(np.diff(f[i:j], prepend=np.uint64(0)).astype("<u8"), n[i:j]) for i, j in zip(at, [*at[1:], len(f)], strict=True)]
                yield pd.DataFrame({"part": own[at].astype(np.int64), "block": block, "data": sent})
        release()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(d, "<u8", "<u4") for d in pdf["data"]]
        every = np.concatenate([np.cumsum(f, dtype=np.uint64) for f, _ in got])
        order, first = ordered(every)
        df = np.empty(len(every), "<u4")
        df[order] = np.repeat(np.add.reduceat(np.concatenate([n for _, n in got])[order], first, dtype=np.int64), np.diff(np.append(first, len(every))))
        at = np.cumsum([0, *[len(f) for f, _ in got]])
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "back": [pack(df[i:j]) for i, j in zip(at, at[1:], strict=False)]})

    sent = held.select("block", "data").mapInPandas(send, "part long, block long, data binary")
    with few_rows(held.sparkSession):
        back = cut(sent.groupBy("part").applyInPandas(add, "block long, part long, back binary"))
    return back.groupBy("block").agg(F.collect_list(F.struct("part", "back")).alias("back"))


def framed(docs: DataFrame, limit: int = BLOCK_BYTES, part: int | None = None) -> tuple[DataFrame, int]:
    """(block, data, back) of all texts of ``docs`` (node, text), and how many documents have a shingle."""
    held = cut(blocks(docs, limit))
    total = held.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("shingles"), F.lit(0)).alias("shingles")).first()
    return held.select("block", "data").join(frequencies(held, max(16, total["shingles"] // (part or PART))), "block", "left"), total["docs"]


def counted(data: bytes, back: list | None) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, sorted distinct shingles, how often each occurs, in how many documents) of each text of a framed block."""
    nodes, _, texts = texts_of(data)
    sets = sets_of(texts)
    every = np.concatenate([f for f, _ in sets]) if sets else np.zeros(0, np.uint64)
    df, at = np.zeros(len(every), np.uint32), 0
    if len(every):
        order, first = ordered(every)
        own = np.concatenate([unpack(r["back"], "<u4")[0] for r in sorted(back, key=lambda r: r["part"])])
        df[order] = np.repeat(own, np.diff(np.append(first, len(every))))
    for node, (f, n) in zip(nodes, sets, strict=True):
        yield node, f, n, df[at : at + len(f)]
        at += len(f)
