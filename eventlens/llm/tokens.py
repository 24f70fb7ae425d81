"""Token ids of texts inside tasks, with public vocabularies given by path.

Both encoders keep a bounded table of what they have encoded: the vocabularies are applied to
pieces of text that cannot influence each other (see each class), so the ids of a text are the ids
of its pieces put together.
"""

from __future__ import annotations

import base64
import os
import re
from collections import ChainMap
from collections.abc import Callable
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Chunks that a worker remembers, for as long as it lives (about 200 bytes each).
MAX_KEPT = 600_000
# New chunks that are encoded as one text.
CHUNKS = 512
# Fixed value: the published splitting pattern of the 50k byte-level vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_END = 50_256
# White space to Python's split() but not to the tokenizers' patterns.
_ODD_BLANKS = re.compile("[\x1c-\x1f]")


class WordEncoder:
    """Ids as little-endian unsigned 32-bit numbers, from a tokenizer that drops white space.

    Such a tokenizer never looks across white space, so texts are split there and every distinct
    chunk is encoded once. Chunks that are new are encoded many at a time, as one text with blanks
    between them; the places of its tokens tell them apart. ``known`` stops growing at ``MAX_KEPT``
    chunks; others are encoded anew.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        # whether case makes no difference; special tokens are spelled in lower case
        self.lower = self._whole("ABC") == self._whole("abc")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        if "<|" in "".join(chunks):  # a special token may take the blank beside it
            out = {c: self._whole(c) for c in chunks if "<" in c or "|" in c}
            chunks = [c for c in chunks if c not in out]
        runs = [chunks[i : i + CHUNKS] for i in range(0, len(chunks), CHUNKS)]
        for run, found in zip(runs, self.tokenizer.encode_batch([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4").tobytes()
            lengths = np.fromiter(map(len, run), dtype=np.int64, count=len(run))
            starts = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            cuts = (4 * np.append(np.searchsorted(starts, np.cumsum(lengths + 1) - lengths - 1), len(starts))).tolist()
            out.update(zip(run, map(ids.__getitem__, map(slice, cuts, cuts[1:]))))
        return out

    def many(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for text in texts:
            if _ODD_BLANKS.search(text):
                split.append(None)
                continue
            if self.lower and text.isascii() and "<|" not in text:
                text = text.lower()  # fewer distinct chunks
            split.append(text.split())
        known = self.known
        new = list(set().union(*[chunks for chunks in split if chunks]).difference(known))
        look = known
        if new:
            extra = self._encoded(new)
            if len(known) + len(extra) <= MAX_KEPT:
                known.update(extra)
            else:
                look = ChainMap(known, extra)
        return [
            self._whole(text) if chunks is None else b"".join(map(look.__getitem__, chunks))
            for text, chunks in zip(texts, split)
        ]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per path and Python worker."""
    return WordEncoder(path)


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> Callable[[str], list[int]]:
    """Lossless byte-level ids; strings that look like special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
