"""Tokenisation to packed ids with a public byte-pair vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Path of the vocabulary (ranks, one "base64 rank" line each); pass another where it lies elsewhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Encodes texts to little-endian id arrays (``dtype``); ``eot`` is the first free id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.eot = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2") if self.eot < 1 << 16 else np.dtype("<u4")
        self._bytes: list[bytes] = [b""] * (self.eot + 1)
        for piece, rank in ranks.items():
            self._bytes[rank] = piece
        self._lengths = np.array([len(b) for b in self._bytes], dtype=np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of the whole text; a null text has none."""
        return np.asarray(self._encoding.encode_ordinary(text) if text else [], dtype=self.dtype)

    def byte_lengths(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of text that each id stands for; 0 for ``eot``."""
        return self._lengths[ids]

    def decode(self, raw: bytes) -> str:
        """The text of packed ids (``eot`` gives none)."""
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(raw, self.dtype))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER) -> Encoder:
    """The encoder of a vocabulary, loaded once in each Python worker."""
    return Encoder(path)
