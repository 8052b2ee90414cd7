"""Token counts, with huge documents encoded in overlapping chunks that are spliced.

A byte-level BPE splits a text at the matches of a regular expression (special
strings first) and then merges within each of these pre-tokens only.  From a
pre-token's start on, the split depends on nothing before it.  So if a place is
the start of a pre-token both in a chunk whose own beginning is known to be
such a start and in the next, overlapping chunk, the tokens of the first up to
this place and of the second from there on are those of the whole text.  The
place must also lie so far before the first chunk's end that neither a look
ahead nor a special string could reach past it.  Where two chunks share no
such place, the overlap doubles; in the last resort the chunk itself grows.

Texts that need no chunks are cut by the same reasoning at each space before a
character that is no white space.  A pre-token holds a space only at its own
beginning or among white space, and of a run of white space the last space is
left to the word after it: so such a space is always the start of a pre-token,
and what stands before it splits as it does at the end of a text.  The library
gets a word once, as long as a task's table keeps its number of tokens (the
table is emptied when full); a text's tokens are the sum of its words'.  Texts
with special strings go to the library whole, and so do all texts if the
tokenizer is not of the family for which this is proven.

Defined results: a null text counts as empty and has 0 tokens; repeated rows
give repeated results; of the columns asked for, those named n_bytes, n_tokens
or over_limit (case aside) give way to the results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_texts, ship, slices, small_batches

ship(__name__)

CHUNK, OVERLAP = 32_768, 512
SLICE_CHARS = 500_000
#: Entries of a task's table of words, and the length of a word in it.
TABLE_WORDS, WORD_CHARS = 400_000, 64
#: A space in the alphabet that stands for bytes.
SPACE = "\u0120"
#: All that any version of Unicode has as white space, and some characters more: no cut is made before these.
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
CUT, DOUBTFUL = re.compile(f" (?=[^{BLANK}])"), re.compile(f" (?:[{BLANK}]|\\Z)")


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, table_words: int = TABLE_WORDS):
        self.chunk, self.overlap, self.margin = chunk, overlap, 2
        self.table_words, self.table = table_words, {}
        if path.endswith(".model"):
            import sentencepiece

            self.piece, self.spliced, self.tabled = sentencepiece.SentencePieceProcessor(model_file=path), False, False
            return
        import tokenizers

        self.piece, self.bpe = None, tokenizers.Tokenizer.from_file(path)
        self.bpe.no_truncation()
        self.bpe.no_padding()
        spec = json.loads(self.bpe.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        # Splicing is proven for this family only; other tokenizers encode whole texts.
        self.spliced = model["type"] == "BPE" and not model.get("dropout") and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = spec.get("added_tokens") or []
        self.spliced = self.spliced and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.margin += max((len(t["content"]) for t in added), default=0)
        self.special = [t["content"] for t in added]
        vocab = self.bpe.get_vocab()
        self.tabled = self.spliced and SPACE in vocab and not any(" " in t for t in self.special)
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)  # of each token, whether it begins with a space
        self.spaced[[n for t, n in vocab.items() if t.startswith(SPACE)]] = True

    def whole(self, texts: list[str]) -> list[int]:
        if self.piece:
            return [len(x) for x in self.piece.encode(texts, num_threads=1)]
        return [len(x) for x in self.bpe.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, texts: list[str]) -> list[int]:
        """As ``whole``, for texts without special strings: the sums of their words' tokens."""
        parts = [t.split(" ") if not DOUBTFUL.search(t) else CUT.split(t) for t in texts]
        out = self.whole([p.pop(0) for p in parts])  # no space before it
        fresh = set().union(*parts).difference(self.table)
        if len(self.table) + len(fresh) > self.table_words:
            self.table.clear()
            fresh = set().union(*parts)
        once = self.learn(fresh)
        for k, p in enumerate(parts):
            out[k] += sum(map(self.table.__getitem__, p))
        for w in once:
            del self.table[w]
        return out

    def learn(self, fresh: set[str]) -> list[str]:
        """Put words that follow a space into the table; those returned are too long to stay there."""
        plain = [w for w in fresh if " " not in w and len(w) <= WORD_CHARS]
        for i in range(0, len(plain), 500):
            some = plain[i : i + 500]
            # The only space of each word is before it, so a token that begins with a space begins a word.
            ids = np.array(self.bpe.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids)
            begin = np.flatnonzero(self.spaced[ids])
            self.table.update(zip(some, np.diff(begin, append=len(ids)).tolist(), strict=True))
        other = [w for w in fresh if " " in w or len(w) > WORD_CHARS]
        self.table.update(zip(other, self.whole([" " + w for w in other]), strict=True))
        return [w for w in other if len(w) > WORD_CHARS]

    def starts(self, text: str, at: int) -> tuple[list[int], dict[int, int]]:
        """Of a chunk that begins at ``at``: each token's place, and each pre-token's place with its first token's index."""
        e = self.bpe.encode(text, add_special_tokens=False)
        places, words, first = [at + a for a, _ in e.offsets], e.word_ids, {}
        for k, place in enumerate(places):
            if k == 0 or words[k] != words[k - 1] or words[k] is None:
                first.setdefault(place, k)
        return places, first

    def huge(self, text: str) -> int:
        """Tokens of a text of any length, by splicing chunks."""
        total, lo, size = 0, 0, self.chunk
        places, first = self.starts(text[:size], 0)
        since = 0  # tokens of the present chunk before this index are counted
        while lo + size < len(text):
            end, overlap = lo + size, self.overlap
            while True:
                nxt = max(lo + 1, end - overlap)
                more, then = self.starts(text[nxt : nxt + size], nxt)
                common = [p for p in first if nxt < p <= end - self.margin and p in then and first[p] >= since and first[p] > 0]
                if common or nxt == lo + 1:
                    break
                overlap *= 2
            if common:
                p = common[len(common) // 2]
                total += first[p] - since
                lo, places, first, since = nxt, more, then, then[p]
            else:
                size *= 2
                places, first = self.starts(text[lo : lo + size], lo) if since == 0 else self.again(text, places[since], size)
                if since:
                    lo, since = places[0], 0
        return total + len(places) - since

    def again(self, text: str, at: int, size: int) -> tuple[list[int], dict[int, int]]:
        """From a proven start on, a longer chunk."""
        return self.starts(text[at : at + size], at)

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = [0] * len(texts)
        huge = {k for k, t in enumerate(texts) if self.spliced and len(t) > self.chunk}
        whole = {k for k, t in enumerate(texts) if not self.tabled or any(s in t for s in self.special)} - huge
        for ks, by in ((sorted(whole), self.whole), (sorted(set(range(len(texts))) - huge - whole), self.words)):
            for i, j in slices([len(texts[k]) for k in ks], SLICE_CHARS):
                for k, n in zip(ks[i:j], by([texts[k] for k in ks[i:j]]), strict=True):
                    out[k] = n
        for k in huge:
            out[k] = self.huge(texts[k])
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512, columns: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of ``docs``: the given columns, n_bytes, n_tokens and over_limit."""
    small_batches(docs.sparkSession)

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = None
        for pdf in batches:
            counter = counter or Counter(path, chunk, overlap)
            texts = ["" if t is None else t for t in pdf.pop("__text")]
            pdf["n_bytes"] = [len(t.encode()) for t in texts]
            pdf["n_tokens"] = counter.count(texts)
            pdf["over_limit"] = pdf["n_tokens"] > limit
            yield pdf

    return map_texts(docs, columns, "n_bytes long, n_tokens long, over_limit boolean", op)
