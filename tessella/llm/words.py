"""Vectorised word hashing shared by the operators that look at words.

A word is a maximal run of ASCII letters and digits, underscores and other non-ASCII characters
than spaces, punctuation and symbols, in lower case.  In scripts that are written without spaces
(Chinese, Japanese, Thai, Lao, Khmer, Burmese) every character is a word.  The hash of a word is a
polynomial in its UTF-8 bytes modulo 2**64, taken from prefix sums so that a whole batch of
texts costs a few numpy passes and no Python work per word, and then mixed (splitmix64).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_SEPARATORS = bytes(c for c in range(128) if not (chr(c).isalnum() or c == 95))
_TABLE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_U = np.uint64
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=_U)
        out[0] = 1
        return np.multiply.accumulate(out)

    global _powers
    if n > CHUNK_BYTES * 4:  # a single huge document: not kept
        return table(_P, n), table(_P_INV, n)
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers = table(_P, size), table(_P_INV, size)
    return _powers


def _hash_bytes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the space-separated words of ``joined`` and where each starts."""
    buf = np.frombuffer(joined, dtype=np.uint8)
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = buf != 32
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(buf * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts


#: Latin-1 signs, spaces and punctuation of all scripts, and symbols up to the braille patterns.
_MARKS = re.compile("[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\u055a-\u055f\u0589\u05be\u060c\u061b\u061f\u066a-\u066d\u06d4\u0964\u0965\u1361-\u1368\u1680\u17d4-\u17da\u2000-\u200b\u200e-\u206f\u20a0-\u20cf\u2190-\u28ff\u2e00-\u2e7f\u3000-\u3004\u3008-\u3020\u3030\u30fb\ufe10-\ufe1f\ufe30-\ufe6f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17d3\u3005-\u3007\u3041-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: Bytes that no other character than those (and some letters) has, once all else is deleted.
_USUAL = bytes(c for c in range(256) if c < 0xD5 and c != 0xC2)


def plain(text: str) -> bytes:
    """Lower-case words, separated by spaces."""
    text = text.lower()
    raw = text.encode("utf-8", "replace")
    if raw.translate(None, _USUAL):
        raw = _UNSPACED.sub(r" \g<0> ", _MARKS.sub(" ", text)).encode("utf-8", "replace")
    return raw.translate(_TABLE)


_SHAPES = bytes(32 if c in b" \t\n\r\f\v" else 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


def shapes(text: str) -> bytes:
    """The shapes of space-separated tokens: runs of capitals, other letters and digits become
    one A, a and 0, and punctuation stays."""
    raw = np.frombuffer(text.encode("utf-8", "replace").translate(_SHAPES), dtype=np.uint8)
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != raw[:-1]) | ((raw[1:] != 97) & (raw[1:] != 65) & (raw[1:] != 48))
    return raw[keep].tobytes()


def word_batches(texts: list[str | None], chunk_bytes: int = CHUNK_BYTES, prepare: Callable[[str], bytes] = plain) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first text, word hashes, words per text) for runs of texts of about
    ``chunk_bytes`` each, as ``prepare`` leaves them.  A null text counts as an empty one; one long text is its own run."""
    first, size, parts = 0, 0, []
    for i, text in enumerate(texts):
        raw = prepare(text or "")
        if parts and size + len(raw) > chunk_bytes:
            yield (first, *_run(parts))
            first, size, parts = i, 0, []
        parts.append(raw)
        size += len(raw) + 1
    if parts:
        yield (first, *_run(parts))


def _run(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, starts = _hash_bytes(b" ".join(parts))
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def word_hashes(text: str | None) -> np.ndarray:
    """Word hashes of one text, in order."""
    return next(word_batches([text], 1 << 62))[1]


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within each text, and their number per text.  A text of
    1 to n-1 words gives one shingle, of all of its words; a text without words none."""
    if n == 1:
        return words, counts
    full = np.maximum(counts - n + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    position = np.arange(len(words))
    keep = position + n <= ends[owner]
    rolled = np.zeros(len(words), dtype=_U)
    for j in range(n):
        rolled[: len(words) - j] = mix(rolled[: len(words) - j] * _U(0x9E3779B97F4A7C15) + words[j:] + _U(j + 1))
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return rolled[keep], full
    out_counts = full.copy()
    out_counts[short] = 1
    out = np.empty(int(out_counts.sum()), dtype=_U)
    at = np.cumsum(out_counts) - out_counts
    is_short = np.zeros(len(out), dtype=bool)
    is_short[at[short]] = True
    out[~is_short] = rolled[keep]
    for i in short:
        h = np.full(1, counts[i], dtype=_U)
        for j in range(ends[i] - counts[i], ends[i]):
            h = mix(h * _U(0x9E3779B97F4A7C15) + words[j : j + 1])
        out[at[i]] = h[0]
    return out, out_counts
