"""Vectorised word and hash primitives over UTF-8 bytes.

Everything here works on one numpy buffer that holds many documents, so the cost per
document is a few array operations rather than a Python loop over its words.
Hashes are 64-bit; operators that decide equality combine two of them (128 bits).
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE_BYTE = 0x9E3779B97F4A7C15
_BASE_WORD = 0xD6E8FEB86659FD93
_BASE_ALT = 0xC2B2AE3D27D4EB4F


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            steps = np.full(size, self.base, dtype=U64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self.inverse
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


_BYTES, _WORDS, _ALT = _Powers(_BASE_BYTE), _Powers(_BASE_WORD), _Powers(_BASE_ALT)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _prefix(values: np.ndarray, powers: _Powers) -> np.ndarray:
    up, _ = powers.upto(len(values) + 1)
    out = np.empty(len(values) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def _ranged(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    _, down = powers.upto(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


class ByteHash:
    """Hashes of any byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        self.prefix = _prefix(_TABLE[buf], _BYTES)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(_ranged(self.prefix, start, end, _BYTES) + (end - start).astype(U64))


class SequenceHash:
    """Two independent hashes of any ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.first, self.second = _prefix(values, _WORDS), None
        self.values = values

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(_ranged(self.first, start, end, _WORDS) + (end - start).astype(U64))

    def other(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.second is None:
            self.second = _prefix(mix(self.values ^ U64(0xA0761D6478BD642F)), _ALT)
        return mix(_ranged(self.second, start, end, _ALT) - (end - start).astype(U64))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of several documents in one buffer.

    starts, ends: byte ranges; first: index of each document's first word, with the
    number of words at its end.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        self.buf = np.frombuffer(self.data, dtype=np.uint8)
        inside = np.zeros(len(self.buf) + 2, dtype=bool)
        np.logical_not(_SPACE[self.buf], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.doc_at = at
        self.first = np.searchsorted(self.starts, at)

    def hashes(self) -> np.ndarray:
        return ByteHash(self.buf).of(self.starts, self.ends)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i with a full window."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def chunks(texts, limit: int = 1 << 20):
    """Lists of (index, text) whose texts hold about `limit` bytes; a text is never cut."""
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append((i, t))
        size += len(t) + 1
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part
