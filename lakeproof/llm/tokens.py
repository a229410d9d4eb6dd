"""Token ids of a public byte-level BPE vocabulary, with a bounded cache of whole chunks."""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

#: Splits a text before the merges of byte-level vocabularies of this family (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of non-blanks with at most one space before it. PATTERN never joins characters over such a chunk's border, so the ids
#: of a text are those of its chunks. The four separators are blank to Python and not to the vocabulary's own splitter.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD_BLANK = re.compile("[\x1c-\x1f]")
CACHED_CHUNKS = 400_000
LONGEST_CACHED = 40


def _byte_of_symbol() -> dict[str, int]:
    """The printable symbol of each byte in a byte-level vocabulary file: itself, or the next free one above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Encodes texts with the vocabulary of a tokenizer file (JSON); special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in spec.get("added_tokens", ())}
        symbols = _byte_of_symbol()
        ranks = {bytes(symbols[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._cache: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        ids = np.array(self._bpe.encode_ordinary(chunk), "<u4").tobytes()
        if len(chunk) <= LONGEST_CACHED and len(self._cache) < CACHED_CHUNKS:
            self._cache[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        if ODD_BLANK.search(text):
            return np.array(self._bpe.encode_ordinary(text), "<u4")
        get, chunk = self._cache.get, self._chunk
        return np.frombuffer(b"".join([get(c) or chunk(c) for c in CHUNK.findall(text)]), "<u4")
