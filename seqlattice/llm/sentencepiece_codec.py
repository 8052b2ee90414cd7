"""SentencePiece encoding and decoding by a table of distinct marked chunks.

If no piece of the model holds a whitespace marker after another character, a
merge can never join characters across such a place.  The normalised text then
falls into chunks (markers followed by other characters) that the model
segments independently, and the ids of the text are the chunks' ids in order.
Each distinct chunk is segmented once per table; texts look their chunks up by
position.  A table lives in a task and is emptied at ``TABLE_ROWS`` entries, so
occurrences are never shuffled and memory stays bounded.  Chunks of more than
``LONG_CHUNK`` characters are segmented for the batch at hand and not kept.  Models
that do have such pieces take the library's direct path.

Defined results: a null text counts as empty; an empty text has the end id
alone; repeated rows give repeated results; extra columns are kept on request,
but for those (case aside) that have a result's name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_texts, release, ship, slices, small_batches

ship(__name__)

MARK = "▁"
TABLE_ROWS = 300_000
LONG_CHUNK = 384
SLICE_CHARS = 1_000_000


def crosses(piece: str) -> bool:
    """Whether a marker follows another character inside the piece."""
    return re.search(f"[^{MARK}]{MARK}", piece) is not None


class Codec:
    """Encodes batches of texts and decodes the ids again."""

    def __init__(self, model_file: str, table_rows: int = TABLE_ROWS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.sp.get_piece_size()
        kinds = (self.sp.is_control, self.sp.is_unknown, self.sp.is_byte)
        plain = [i for i in range(n) if not any(kind(i) for kind in kinds)]
        self.separable = (
            not any(crosses(self.sp.id_to_piece(i)) for i in plain)
            and not self.sp.is_unknown(self.sp.piece_to_id(MARK))
            and self.sp.normalize("a") == f"{MARK}a"
            and self.sp.normalize(" a  b ") == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"
            and self.sp.decode(self.sp.encode("  a")) == "  a"
        )
        self.end = self.sp.eos_id()
        self.chunk = re.compile(f"{MARK}+[^{MARK}]*")
        self.rows, self.ids, self.back = table_rows, {}, {}

    def chunks(self, text: str) -> list[str]:
        """The chunks of the normalised text, each without its first marker."""
        text = self.sp.normalize(text)
        if MARK * 2 not in text:
            return text.split(MARK)[1:]
        return [c[1:] for c in self.chunk.findall(text)]

    def segmented(self, new: list[str]) -> Iterator[tuple[str, str, str]]:
        """(chunk, its ids in decimal, what they decode to)"""
        ids = self.sp.encode([c.replace(MARK, " ") for c in new], num_threads=1)
        ids = [own or [self.sp.piece_to_id(MARK)] for own in ids]  # a lone marker ends the text
        for c, own, back in zip(new, ids, self.sp.decode(ids), strict=True) if new else ():
            yield c, " ".join(map(str, own)), back

    def learn(self, wanted: set[str]) -> None:
        """Segment each chunk that the table lacks, once."""
        new = [c for c in wanted if c not in self.ids]
        if len(self.ids) + len(new) > self.rows:
            self.ids, self.back = {}, {}
            new = list(wanted)
        for c, own, back in self.segmented(new):
            self.ids[c] = own
            if back != c:  # of few
                self.back[c] = back

    def direct(self, text: str) -> tuple[int, str, str]:
        ids = [*self.sp.encode(text), self.end]
        return len(ids), " ".join(map(str, ids)), self.sp.decode(ids)

    def run(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, the ids in decimal, the decoded text) of each text."""
        if not self.separable:
            yield from map(self.direct, texts)
            return
        parts = [self.chunks(t) if t else [] for t in texts]
        wanted = set().union(*parts)
        long = {c for c in wanted if len(c) > LONG_CHUNK}
        self.learn(wanted - long)
        ids, back, end = self.ids.__getitem__, self.back, str(self.end)
        once = {c: (own, other) for c, own, other in self.segmented(sorted(long))}
        for p in parts:
            if long and not long.isdisjoint(p):
                row = " ".join([*(once[c][0] if c in once else ids(c) for c in p), end])
                text = " ".join(once[c][1] if c in once else back.get(c, c) for c in p)
            else:
                row, text = " ".join([*map(ids, p), end]), " ".join(p) if back.keys().isdisjoint(p) else " ".join([back.get(c, c) for c in p])
            yield row.count(" ") + 1, row, text


def encode(docs: DataFrame, model_file: str, columns: tuple[str, ...] = ("doc_id",), full: bool = False) -> DataFrame:
    """One row for each row of ``docs``: the given columns, n_tokens, ids_sha256 and decoded_sha256.

    With ``full``, also ``ids`` (array of int) and ``decoded`` (string).
    """
    small_batches(docs.sparkSession)
    results = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = None
        for pdf in batches:
            codec = codec or Codec(model_file)
            texts = ["" if t is None else t for t in pdf.pop("__text")]
            for i, j in slices([len(t) for t in texts], SLICE_CHARS):
                got = list(codec.run(texts[i:j]))
                out = pdf.iloc[i:j].copy()
                out["n_tokens"] = [n for n, _, _ in got]
                out["ids_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for _, x, _ in got]
                out["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for _, _, x in got]
                if full:
                    out["ids"] = [np.array(x.split(), np.int32) for _, x, _ in got]
                    out["decoded"] = [x for _, _, x in got]
                yield out
        release()

    return map_texts(docs, columns, results, op)
