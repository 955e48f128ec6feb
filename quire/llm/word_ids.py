"""Token ids of whole texts under the word-end BPE vocabulary, with a bounded memo per worker.

The vocabulary drops white space and splits the rest into pieces that are encoded apart from each other,
so what stands between white space (a chunk) has ids of its own, looked up once and joined. Texts outside
ASCII and the accented Latin-1 letters, and texts that may hold a special token, go through the tokenizer
itself, so results equal its own for any text.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from itertools import islice

import numpy as np

#: Lower-casing and white space are the same here and in the tokenizer; normalisation changes nothing.
PLAIN = re.compile("[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]*")
#: Chunks that have recurred and chunks seen in one batch of texts so far, about 0.2 KB each, that the memo may
#: hold: the common ones stay while the many rare ones pass through. An executor may keep more workers than it has
#: tasks, each with a memo of its own.
MEMO_RECURRED, MEMO_FRESH = 250_000, 200_000
#: Longer chunks are forgotten after the texts they stand in.
LONG_CHUNK = 100


class WordEncoder:
    """ids(text) -> little-endian unsigned 32-bit ids, as `encode(text, add_special_tokens=False)` has them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        self.whole, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.whole, self.bare):
            t.no_truncation()
            t.no_padding()
        self.bare.normalizer = normalizers.Sequence([])  # chunks are lower-cased already
        self.batch = getattr(self.bare, "encode_batch_fast", self.bare.encode_batch)
        self.memo: dict[str, bytes] = {}
        self.fresh: set[str] = set()  # chunks of the memo that one batch of texts has held so far

    def slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Add the ids of chunks; collections are put off while short-lived lists are made."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            for at in range(0, len(chunks), 4096):
                some = chunks[at : at + 4096]
                self.memo.update(zip(some, [array("I", e.ids).tobytes() for e in self.batch(some, add_special_tokens=False)], strict=True))
        finally:
            if collecting:
                gc.enable()

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        chunks = {}
        for k, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text or not PLAIN.fullmatch(text):
                out[k] = self.slow(text)
            else:
                chunks[k] = text.lower().split()
        memo, here = self.memo, set().union(*chunks.values())
        self.fresh -= here
        new = list(here.difference(memo))
        self.learn(new)
        for k, some in chunks.items():
            out[k] = b"".join([memo[c] for c in some])
        for c in new:
            if len(c) > LONG_CHUNK:
                del memo[c]
            else:
                self.fresh.add(c)
        self.bound()
        return out

    def bound(self) -> None:
        """Fresh chunks go all at once; of those that recurred the later half, as the common ones come first."""
        if len(self.fresh) > MEMO_FRESH:
            for c in self.fresh:
                del self.memo[c]
            self.fresh = set()
        if len(self.memo) - len(self.fresh) > MEMO_RECURRED:
            kept = [c for c in self.memo if c not in self.fresh]
            for c in kept[len(kept) // 2 :]:
                del self.memo[c]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
