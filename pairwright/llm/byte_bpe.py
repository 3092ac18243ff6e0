"""Byte-level BPE ids by the ``tokenizers`` library, with chunks that were encoded before reused.

The pre-tokeniser's pattern never joins what stands before a single space between two
non-space characters with what stands after it, and a line break between two non-space
characters is a token by itself. Texts are cut there, and each chunk is encoded once for
as long as it stays in the cache.
"""

from __future__ import annotations

import base64
import re
import struct

import numpy as np
import public_tokenizers

from pairwright.llm.common import WordCache

FILE = "byte_bpe_50k.json"
#: The same vocabulary as merge ranks.
RANKS = "byte_bpe_50k.tiktoken"
#: A single space between two characters that are not white space.
CUT = re.compile(r"(?<=\S) (?=\S)")


def default_path() -> str:
    return public_tokenizers.path(FILE)


def _by_ranks():
    import tiktoken

    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ByteBpe:
    """``path``: a tokenizer file; None: the public one, whose chunks are encoded by its ranks, which is faster for short texts."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.by_ranks = _by_ranks() if path in (None, default_path()) else None
        self.first = WordCache(lambda x: self.chunk(x) if _closed(x) else None)
        self.rest = WordCache(lambda x: self.chunk(" " + x) if _closed(x) else None)
        self.newline = self.direct("\n")

    def direct(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers, without the cache."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def chunk(self, text: str) -> bytes:
        """As ``direct``; a chunk that may hold a special token goes to the tokenizer itself."""
        if self.by_ranks is None or "<|" in text:
            return self.direct(text)
        return struct.pack(f"<{len(ids := self.by_ranks(text))}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """As ``direct``, by way of chunks."""
        if not text:
            return b""
        self.first.trim()
        self.rest.trim()
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.first[first])
            out.extend(map(self.rest.__getitem__, rest))
            out.append(self.newline)
        if None not in out:
            return b"".join(out[:-1])
        first, *rest = CUT.split(text)
        return self.direct(first) + b"".join(self.rest[x] or self.direct(" " + x) for x in rest)


def _closed(chunk: str) -> bool:
    """Whether a chunk has no white space at its ends, so that its neighbours can't change its ids."""
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()
