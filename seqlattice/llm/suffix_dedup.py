"""Suffix-array dedup: bytes that repeat an earlier document go.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller doc_id.  Strings are judged on the input; they never
cross documents.

The method is a distributed merge sort of suffixes that knows common prefixes:

1. Anchors.  Each window of ``LENGTH`` bytes has an anchor: the start of its
   ``GRAM``-byte string with the least hash (the leftmost of equals).  Equal
   windows have equal anchors, and neighbouring windows mostly share theirs, so
   only the suffixes at anchors are sorted, each with the windows it stands for.
2. Duplicate detection.  A window matters only if what it holds around its anchor
   (35 bytes, to the right or to the left) occurs in two documents.  Texts are
   gathered into blocks; a block sends the sorted hashes of these once (five bytes
   each, before compression), cut into parts, and gets back a bit for each in
   their order.  Nothing is collected, so it prunes as well at any size; a wrong hit
   costs time only.
3. Runs.  A task sorts the suffixes it has left, in runs of at most ``RUN``.
   Equal suffixes with equal contexts in one run are sent once, with the least
   document; the others repeat that one, so their marks are known on the spot.
   This keeps a passage that a third of all documents share down to one entry
   for each run.  Runs are front-coded (the length of the prefix shared with the
   entry before, and the rest) and cut at splitters taken from a sample.
4. Merge.  For each range a loser tree merges the runs.  Each contender carries
   the prefix length it shares with the last winner: different lengths decide
   at once, equal ones compare from there on, so known prefixes are never
   compared again.
5. Windows.  Suffixes that share an anchor string are now neighbours; among the
   windows around one anchor string, those of equal bytes get their least
   document.  Windows of later documents mark their bytes.

Equal texts are found first by 128 bits of SHA-256 of the whole: a later copy goes
wholly.  Windows around one anchor string are grouped by a hash, and a window is
marked once its bytes equal those of its group's earliest; where a group holds
different bytes, they are told apart.

The numbers of parts and of ranges follow the bytes of the input, so that each
holds about as much however large it is.  A range's anchor string is one group of
one merge: what keeps it small is that equal entries of a run are sent once.

Defined results: a null text counts as empty; a text shorter than ``LENGTH``
stays whole; a null id comes before all others; rows that repeat an id are one
document, so they don't repeat each other, and each is cut alike.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, ship, small_batches
from .shingles import mixed, powers

ship(__name__)

LENGTH, GRAM = 50, 20
BLOCK_BYTES = 8_000_000
PART_BYTES = 4_000_000  # of text, for each part of the hashes and range of the suffixes
RUN = 300_000
SAMPLE, SAMPLED_BLOCKS = 20_000, 16
CHECKED = 20_000
SLICE_BYTES = 450_000
PLACE_BITS = 20  # of a place within a slice; longer texts are cut into overlapping slices
FIRST = -(1 << 63)


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each place on, by doubling."""
    factor = powers(0xD6E8FEB86659FD93, n + 1)
    power, size = mixed(data.astype(np.uint64) + np.uint64(0x51)), 1
    have, total = None, 0
    while True:
        if n & size:
            if have is None:
                have, total = power, size
            else:
                m = min(len(have), len(power) - total)
                have, total = have[:m] * factor[size] + power[total : total + m], total + size
        if total == n:
            return have
        m = max(0, len(power) - size)
        power, size = power[:m] * factor[size] + power[size : size + m], size * 2


class Anchors:
    """Texts joined end to end, and their runs of windows with one anchor, as arrays.

    text, first, last, at: the run's text, first and last window and anchor, as
    places in ``data``.  A window that begins ``o`` bytes before its anchor holds
    the ``length - half`` bytes from the anchor on if ``o <= half``, and the
    bytes from ``half`` before the anchor to its end if ``o >= half``: ``right``
    and ``left`` are 40-bit hashes of these, where ``has_right`` and
    ``has_left`` say that the run has such windows.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        self.data = data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = np.maximum(sizes - length + 1, 0)
        text = np.repeat(np.arange(len(texts)), counts)
        self.half = half = (length - gram) // 2
        window = np.arange(counts.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)
        if not len(window):
            self.text = self.first = self.last = self.at = np.zeros(0, np.int64)
            self.right = self.left = np.zeros(0, np.uint64)
            self.has_right = self.has_left = np.zeros(0, bool)
            return
        low = np.uint64((1 << PLACE_BITS) - 1)
        h = mixed(rolling(data, gram))
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have * 2 <= width:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < width:
            m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
        best = m[window]
        new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])]))
        self.text, self.first, self.last, self.at = text[new], window[new], window[np.append(new[1:], len(window)) - 1], (best[new] & low).astype(np.int64)
        after, before = rolling(data, length - half), rolling(data, half + gram)
        self.right = mixed(after[np.minimum(self.at, len(after) - 1)]) >> np.uint64(24)
        self.left = mixed(before[np.clip(self.at - half, 0, len(before) - 1)] ^ np.uint64(0x5DEECE66D)) >> np.uint64(24)
        self.has_right, self.has_left = self.at - self.last <= half, self.at - self.first >= half


def cut_long(texts: list[bytes], length: int = LENGTH, most: int = SLICE_BYTES) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Slices of texts: (parts, the text of each, its offset there); parts of long texts overlap, so each window is in one part."""
    parts, of, offset, total = [], [], [], 0
    for k, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - length + 1), most):
            part = t[lo : lo + most + length - 1]
            if total and total + len(part) > most + length:
                yield parts, of, offset
                parts, of, offset, total = [], [], [], 0
            parts.append(part)
            of.append(k)
            offset.append(lo)
            total += len(part)
    if parts:
        yield parts, of, offset


def planes(h: np.ndarray) -> bytes:
    """Sorted 40-bit hashes as five planes of bytes, of which the high ones compress well."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    got = np.frombuffer(data, np.uint8).reshape(5, -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, :5] = got.T
    return out.view("<u8").ravel()


def packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """How long a prefix each string shares with the one before it (0 for the first)."""
    if not strings:
        return np.zeros(0, np.int64)
    width = max(map(len, strings)) or 1
    grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    sizes = np.array([len(s) for s in strings])
    differ = np.column_stack([grid[1:] != grid[:-1], np.ones(len(strings) - 1, bool)])
    return np.concatenate([[0], np.minimum(differ.argmax(1), np.minimum(sizes[1:], sizes[:-1]))])


def front_code(entries: list[tuple]) -> bytes:
    """Sorted entries (right, left, doc, first window, windows) of one run and range, front-coded."""
    right = [e[0] for e in entries]
    shared = common_prefixes(right)
    rest = [r[k:] for r, k in zip(right, shared.tolist(), strict=True)]
    columns = [
        shared.astype(np.uint8), np.array([len(r) for r in rest], np.uint8), np.array([len(e[1]) for e in entries], np.uint8), np.array([e[4] for e in entries], np.uint8),
        np.array([e[2] for e in entries], "<i8"), np.array([e[3] for e in entries], "<i4"),
    ]
    return packed(b"".join([np.int64(len(entries)).tobytes(), *(c.tobytes() for c in columns), *rest, *(e[1] for e in entries)]))


class Run:
    """One front-coded run of a range; hands out its suffixes in order."""

    def __init__(self, data: bytes):
        data = unpacked(data)
        n = int(np.frombuffer(data, "<i8", 1)[0])
        at, cols = 8, []
        for kind in ("u1", "u1", "u1", "u1", "<i8", "<i4"):
            c = np.frombuffer(data, kind, n, at)
            cols.append(c)
            at += c.nbytes
        self.shared, self.rest, left, self.windows, self.doc, self.first = cols
        ends = at + np.cumsum(self.rest, dtype=np.int64)
        self.prefix, self.ends = self.shared.tolist(), ends.tolist()
        self.begin = [at, *self.ends[:-1]]
        at = self.ends[-1] if n else at
        stop = at + np.cumsum(left, dtype=np.int64)
        self.left = [data[int(b) - int(k) : int(b)] for b, k in zip(stop, left, strict=True)]
        self.data, self.n, self.k, self.now = data, n, -1, b""

    def step(self) -> int:
        """To the next suffix; the prefix it shares with the one before, or -1 at the end."""
        self.k += 1
        if self.k >= self.n:
            return -1
        shared = self.prefix[self.k]
        self.now = self.now[:shared] + self.data[self.begin[self.k] : self.ends[self.k]]
        return shared


def shared_from(a: bytes, b: bytes, k: int) -> int:
    """The length of the common prefix of a and b, known to be k at least."""
    n = min(len(a), len(b))
    if a[k:n] == b[k:n]:
        return n
    while a[k : k + 8] == b[k : k + 8]:
        k += 8
    while a[k] == b[k]:
        k += 1
    return k


def merge(runs: list[Run]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, entry, suffix, prefix shared with the last one) in order, by a loser tree.

    Each contender knows what it shares with the last winner (-1: its run is
    over).  More shared wins; where both share as much, bytes are compared from
    there, and the loser then knows what it shares with the winner.
    """
    width = 1 << max(0, (len(runs) - 1).bit_length())
    shared = [-1] * width
    for r, run in enumerate(runs):
        shared[r] = run.step()
    text = [run.now for run in runs] + [b""] * (width - len(runs))
    losers = [0] * width

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser)"""
        a, b = shared[x], shared[y]
        if a != b:
            return (x, y) if a > b else (y, x)
        if a < 0:
            return x, y
        s, t = text[x], text[y]
        k = shared_from(s, t, a)
        if k == len(s) or (k < len(t) and s[k] < t[k]):
            shared[y] = k
            return x, y
        shared[x] = k
        return y, x

    champions = list(range(width))
    level = width
    while level > 1:
        level //= 2
        for k in range(level):
            champions[k], losers[level + k] = play(champions[2 * k], champions[2 * k + 1])
    best = champions[0]
    while shared[best] >= 0:
        run = runs[best]
        yield best, run.k, text[best], shared[best]
        shared[best] = run.step()
        text[best] = run.now
        node = (best + width) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def same_windows(grid: np.ndarray, back: np.ndarray, entry: np.ndarray, offset: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows ``a`` hold the same bytes as the windows ``b``."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), CHECKED):
        x, y = a[lo : lo + CHECKED], b[lo : lo + CHECKED]
        o = offset[x][:, None]
        most = int(o.max())
        same = ((grid[entry[x], :length] == grid[entry[y], :length]) | (np.arange(length) >= length - o)).all(1)
        same &= ((back[entry[x], :most] == back[entry[y], :most]) | (np.arange(most) >= o)).all(1)
        out[lo : lo + CHECKED] = same & (offset[x] == offset[y])
    return out


def marks_of(right: list[bytes], left: list[bytes], doc: np.ndarray, first: np.ndarray, windows: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Byte ranges (entry, start, end) that windows of later documents cover.

    Each entry stands for ``windows`` windows from ``first`` on; the suffix at
    its anchor is ``right``, what stands before it in the first window ``left``.
    """
    n = len(right)
    lefts = np.array([len(x) for x in left], np.int64)
    most = int(lefts.max())
    grid = np.frombuffer(b"".join(x.ljust(2 * length, b"\0") for x in right), np.uint8).reshape(n, -1)
    back = np.frombuffer(b"".join(x[::-1].ljust(most + 1, b"\0") for x in left), np.uint8).reshape(n, -1)
    factor = powers(0x9E3779B97F4A7C15, length + 1)
    after = np.zeros((most + 1, n), np.uint64)  # [o]: hash of the length - o bytes from the anchor on
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h = h + (grid[:, k].astype(np.uint64) + np.uint64(1)) * factor[k]
        if length - 1 - k <= most:
            after[length - 1 - k] = mixed(h)
    base = mixed(group.astype(np.uint64) + np.uint64(1))
    before = np.zeros(n, np.uint64)
    keys, entry, offset = [], [], []
    for o in range(most + 1):
        if o:
            before = before + (back[:, o - 1].astype(np.uint64) + np.uint64(1)) * factor[o - 1]
        own = np.flatnonzero((lefts >= o) & (lefts - windows + 1 <= o))
        keys.append(mixed(after[o][own] ^ (mixed(before[own]) + base[own] + np.uint64(o * 0xBF58476D1CE4E5B9 % (1 << 64)))))
        entry.append(own)
        offset.append(np.full(len(own), o))
    keys, entry, offset = np.concatenate(keys), np.concatenate(entry), np.concatenate(offset)
    place = first[entry] + lefts[entry] - offset
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    number, docs = np.cumsum(new) - 1, doc[entry[order]]
    least = np.minimum.reduceat(docs, np.flatnonzero(new))[number]
    lowest = np.flatnonzero(docs == least)
    earliest = order[lowest[np.searchsorted(lowest, np.flatnonzero(new))]]  # of each group
    is_later = docs > least
    later, source = order[is_later], earliest[number[is_later]]
    differ = ~same_windows(grid, back, entry, offset, later, source, length)
    if differ.any():  # a group of one hash holds different bytes
        whole = lambda k: (int(group[entry[k]]), int(offset[k]), grid[entry[k], : length - offset[k]].tobytes(), back[entry[k], : offset[k]].tobytes())
        mixed_up = np.isin(number, np.unique(number[is_later][differ]))
        lowest_of: dict[tuple, int] = {}
        for k in order[mixed_up].tolist():
            lowest_of[whole(k)] = min(lowest_of.get(whole(k), int(doc[entry[k]])), int(doc[entry[k]]))
        again = [k for k in order[mixed_up].tolist() if doc[entry[k]] > lowest_of[whole(k)]]
        later = np.concatenate([order[is_later & ~mixed_up], np.array(again, np.int64)])
    if not len(later):
        return np.zeros((3, 0), np.int64)
    e, p = entry[later], place[later]
    by = np.lexsort((p, e))
    e, p = e[by], p[by]
    new = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.append(new[1:], len(e)) - 1
    return np.stack([e[new], p[new], p[last] + length])


def merged_marks(blocks: list[bytes], length: int = LENGTH, gram: int = GRAM, batch: int = 100_000) -> Iterator[pd.DataFrame]:
    """(doc, start, end) from the runs of one range."""
    runs = [Run(b) for b in blocks]
    pending: list[tuple[int, int, bytes, int]] = []
    groups: list[int] = []
    number = 0

    def flush() -> pd.DataFrame:
        doc = np.array([runs[r].doc[k] for r, k, _, _ in pending], np.int64)
        group = np.array(groups)
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        low, high = np.minimum.reduceat(doc, edge), np.maximum.reduceat(doc, edge)
        own = np.flatnonzero(np.repeat(low < high, np.diff(np.append(edge, len(doc)))))
        if not len(own):
            return pd.DataFrame({"doc": [], "start": [], "end": []}).astype("int64")
        some = [pending[k] for k in own]
        found = marks_of([s for _, _, s, _ in some], [runs[r].left[k] for r, k, _, _ in some], doc[own], np.array([runs[r].first[k] for r, k, _, _ in some], np.int64), np.array([runs[r].windows[k] for r, k, _, _ in some], np.int64), group[own], length)
        return pd.DataFrame({"doc": doc[own][found[0]], "start": found[1], "end": found[2]})

    for item in merge(runs):
        if item[3] < gram:
            number += 1
            if len(pending) >= batch:
                yield flush()
                pending, groups = [], []
        pending.append(item)
        groups.append(number)
    if pending:
        yield flush()


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def originals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with ``doc``, ``text`` and ``copy``: whether a smaller id has the same text; and the repeated texts."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    again = cut(own.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("__most")).where("least < __most").select("digest", "least"))
    return own.join(bounded_broadcast(again, 300_000), "digest", "left").select("doc", "text", F.coalesce(F.col("doc") > F.col("least"), F.lit(False)).alias("copy")), again


def blocks(own: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """(block, data): documents (doc, text) packed together."""

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids, texts, size, seq, first = [], [], 0, 0, TaskContext.get().partitionId() << 32
        for pdf in batches:
            for doc, text in zip(pdf["doc"].tolist(), pdf["text"], strict=True):
                ids.append(doc)
                texts.append(text.encode())
                size += len(texts[-1])
                if size >= limit:
                    yield pd.DataFrame({"block": [first + seq], "data": [packed(pickle.dumps((ids, texts)))]})
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield pd.DataFrame({"block": [first + seq], "data": [packed(pickle.dumps((ids, texts)))]})

    return own.select("doc", "text").mapInPandas(op, "block long, data binary")


class Block:
    """The anchors of a block's documents, and the distinct hashes of what they hold to either side."""

    def __init__(self, data: bytes, length: int, gram: int):
        ids, texts = pickle.loads(unpacked(data))
        self.slices = [(Anchors(parts, length, gram), parts, [ids[k] for k in of], offset) for parts, of, offset in cut_long(texts, length)]
        sides = [(h[has], np.array(ids, np.int64)[x.text][has]) for x, _, ids, _ in self.slices for h, has in ((x.right, x.has_right), (x.left, x.has_left))]
        every = np.concatenate([h for h, _ in sides]) if sides else np.zeros(0, np.uint64)
        self.order = np.argsort(every)
        held = every[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
        self.hashes, self.docs = held[self.first], np.concatenate([d for _, d in sides])[self.order] if sides else np.zeros(0, np.int64)

    def twice(self) -> np.ndarray:
        """Whether two documents of the block hold a hash."""
        return np.minimum.reduceat(self.docs, self.first) < np.maximum.reduceat(self.docs, self.first) if len(self.first) else np.zeros(0, bool)

    def hits(self, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice whether the hash to the right and to the left of an anchor is marked."""
        marked = np.empty(len(self.order), bool)
        marked[self.order] = np.repeat(bits, np.diff(np.append(self.first, len(self.order))))
        at = 0
        for x, *_ in self.slices:
            out = []
            for has in (x.has_right, x.has_left):
                side, n = np.zeros(len(has), bool), int(has.sum())
                side[has] = marked[at : at + n]
                at += n
                out.append(side)
            yield out[0], out[1]


def repeated_anchors(held: DataFrame, length: int, gram: int, parts: int, anchors: int) -> tuple[DataFrame, list[bytes]]:
    """(block, back): for each block the parts of its bits, one for each hash: whether two documents hold it; and some ``SAMPLE`` anchor strings, sorted."""
    step = np.uint64(40 - (parts - 1).bit_length())
    # Some SAMPLED_BLOCKS blocks name the splitters; results don't depend on them.
    every = max(1, held.count() // SAMPLED_BLOCKS)
    share = min(1.0, SAMPLE * every / max(1, anchors))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, data in zip(pdf["block"], pdf["data"], strict=True):
                own = Block(data, length, gram)
                twice, at = own.twice(), np.searchsorted((own.hashes >> step).astype(np.int64), np.arange(parts + 1))
                some = [r for r in range(parts) if at[r] < at[r + 1]]
                payload = [len(h).to_bytes(4, "big") + packed(np.packbits(t).tobytes() + planes(h)) for h, t in ((own.hashes[at[r] : at[r + 1]], twice[at[r] : at[r + 1]]) for r in some)]
                yield pd.DataFrame({"part": some, "block": block, "payload": payload})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        for p in pdf["payload"]:
            n, raw = int.from_bytes(p[:4], "big"), unpacked(p[4:])
            got.append((unplanes(raw[-(-n // 8) :]), np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8)), count=n).astype(bool)))
        h, twice = np.concatenate([x for x, _ in got]), np.concatenate([t for _, t in got])
        order = np.argsort(h)
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        times = np.diff(np.append(first, len(h)))
        mark = np.empty(len(h), bool)
        mark[order] = np.repeat((times > 1) | np.logical_or.reduceat(twice[order], first), times)
        at = np.cumsum([0, *[len(x) for x, _ in got]])
        back = [packed(np.packbits(mark[i:j]).tobytes()) for i, j in zip(at, at[1:], strict=False)]
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "n": np.diff(at), "back": back})

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["data"]:
                for x in (Anchors(parts, length, gram) for parts, _, _ in cut_long(pickle.loads(unpacked(data))[1], length)):
                    some = np.flatnonzero((mixed(x.right) >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)) if len(x.at) else ()
                    if len(some):
                        yield pd.DataFrame({"s": sorted({x.data[x.at[k] : x.at[k] + gram].tobytes() for k in some})})

    sample = [bytes(r["s"]) for r in held.where(F.pmod(F.xxhash64("block"), F.lit(every)) == 0).mapInPandas(pick, "s binary").distinct().limit(4 * SAMPLE).collect()]
    back = cut(held.mapInPandas(send, "part long, block long, payload binary").groupBy("part").applyInPandas(gather, "block long, part long, n long, back binary"))
    return back.groupBy("block").agg(F.collect_list(F.struct("part", "n", "back")).alias("back")), sorted(sample)


def repeats(own: DataFrame, length: int = LENGTH, gram: int = GRAM, run: int = RUN, block: int = BLOCK_BYTES, part: int = PART_BYTES) -> DataFrame:
    """(doc, start, end): byte ranges of originals that strings of earlier documents cover."""
    spark = own.sparkSession
    own = own.where("not copy").select("doc", "text")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges = 1 << max(6, (size // part).bit_length())
    held = cut(blocks(own, block))
    back, sample = repeated_anchors(held, length, gram, ranges, size // 15)
    splitters = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    shared = spark.sparkContext.broadcast(splitters)  # ranges - 1 strings of `gram` bytes

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_left

        splitters = shared.value
        entries: list[tuple] = []
        number = 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal entries, number
            entries.sort()
            number += 1
            kept, known, before = [], [], (None, None, None)
            for e in entries:
                if e[0] == before[0] and e[1] == before[1] and e[2] != before[2]:
                    known.append((e[2], e[3], e[3] + e[4] - 1 + length))
                else:
                    kept.append(e)
                    before = e
            for i in range(0, len(known), 50_000):
                yield pd.DataFrame({"range": [-1 - (number + i // 50_000) % ranges], "payload": [np.array(known[i : i + 50_000], "<i8").tobytes()]})
            cuts = [0]
            for s in splitters:
                cuts.append(bisect_left(kept, (s,), cuts[-1]))
            cuts.append(len(kept))
            held = [r for r in range(len(cuts) - 1) if cuts[r] < cuts[r + 1]]
            yield pd.DataFrame({"range": held, "payload": [front_code(kept[cuts[r] : cuts[r + 1]]) for r in held]})
            entries = []

        for pdf in batches:
            for data, back in zip(pdf["data"], pdf["back"], strict=True):
                whole_block = Block(data, length, gram)
                bits = [np.unpackbits(np.frombuffer(unpacked(r["back"]), np.uint8), count=r["n"]) for r in sorted(back, key=lambda r: r["part"])] if back is not None else []
                marked = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
                for (x, parts, ids, offset), (right, left) in zip(whole_block.slices, whole_block.hits(marked), strict=True):
                    if not len(x.at):
                        continue
                    # Windows on a side that no other document shares are left out.
                    first = np.where(left, x.first, np.maximum(x.first, x.at - x.half))
                    last = np.where(right, x.last, np.minimum(x.last, x.at - x.half))
                    own = np.flatnonzero((right | left) & (first <= last))
                    whole = x.data.tobytes()
                    starts = np.cumsum([0, *map(len, parts)])
                    for t, p, q, at in zip(x.text[own].tolist(), first[own].tolist(), last[own].tolist(), x.at[own].tolist(), strict=True):
                        entries.append((whole[at : q + length], whole[p:at], ids[t], p - int(starts[t]) + offset[t], q - p + 1))
                    if len(entries) >= run:
                        yield from flush()
        if entries:
            yield from flush()

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf["range"].iloc[0]) < 0:
            rows = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 3) for p in pdf["payload"]])
            return pd.DataFrame(rows, columns=["doc", "start", "end"])
        return pd.concat(list(merged_marks(list(pdf["payload"]), length, gram)), ignore_index=True)

    return held.join(back, "block", "left").mapInPandas(op, "range int, payload binary").groupBy("range").applyInPandas(gather, "doc long, start long, end long")


def dedup(docs: DataFrame, length: int = LENGTH, full: bool = False, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``full``, also ``kept`` (binary)."""
    small_batches(docs.sparkSession)
    own, again = originals(docs)
    marks = repeats(own, length, **options).groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    rows = rows.join(bounded_broadcast(again, 300_000), "digest", "left").select("doc_id", "doc", "text", F.coalesce(F.col("doc") > F.col("least"), F.lit(False)).alias("copy"))
    # Ids travel as text, since pandas would make floats of them beside nulls.
    met = rows.join(marks, "doc", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "copy", "starts", "ends")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                data = r.text.encode()
                edge = np.zeros(len(data) + 1, np.int64)
                if r.copy and len(data) >= length:
                    edge[0], edge[len(data)] = 1, -1
                elif r.starts is not None:
                    np.add.at(edge, np.asarray(r.starts, np.int64), 1)
                    np.add.at(edge, np.asarray(r.ends, np.int64), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            done = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            done.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield done if full else done.drop(columns="kept")

    out = met.mapInPandas(op, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * full)
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), *out.columns[1:])
