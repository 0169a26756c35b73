"""Vectorised words, word hashes and shingle hashes over an Arrow text column.

All functions work on the UTF-8 buffer of a whole batch, so no Python string
is made for a word.  Words are runs of bytes other than 0x20 and 0x09-0x0D,
which is safe in UTF-8 since those bytes never occur inside a longer code
point.  Hashes have 64 bits; two different shingles of one comparison collide
with a chance near 2**-64 per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = _U(0x100000001B3 * 2 + 0x5851F42D4C957F2D | 1)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_INV = _U(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    """base**i (or its inverse) modulo 2**64 for i < n; grown on demand."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, _BASE if kind == "up" else _INV, dtype=_U)
        step[0] = 1
        have = _POWERS[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _MIX1
    x = x ^ (x >> _U(27))
    x = x * _MIX2
    return x ^ (x >> _U(31))


class Words:
    """The words of each text of a batch.

    ``hashes[first[i]:first[i + 1]]`` are the hashes of text i's words in order;
    ``start`` and ``end`` are byte places in ``data``.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string())
        n = len(texts)
        if n == 0:
            offsets = np.zeros(1, dtype=np.int64)
            raw = np.zeros(0, dtype=np.uint8)
        else:
            if texts.null_count:
                texts = texts.fill_null("")
            _, off, buf = texts.buffers()
            offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1]
            raw = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, dtype=np.uint8)
            raw = raw[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
        self.offsets, self.raw = offsets, raw
        data = LOWER[raw] if lower else raw
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        begins[cuts] |= inside[cuts]  # a text's first byte starts a word of its own
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cuts = cuts[cuts > 0]
        ends[cuts - 1] |= inside[cuts - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hashes = self._hash(data)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        """Polynomial hash of each word from one prefix sum over the batch."""
        out = np.empty(len(self.start), dtype=_U)
        # in blocks of words, so that the power tables stay small
        step = 1 << 16
        for a in range(0, len(self.start), step):
            b = min(a + step, len(self.start))
            lo, hi = self.start[a], self.end[b - 1]
            terms = (data[lo:hi].astype(_U) + _U(1)) * _powers("up", hi - lo)
            total = np.zeros(hi - lo + 1, dtype=_U)
            np.cumsum(terms, out=total[1:])
            s, e = self.start[a:b] - lo, self.end[a:b] - lo
            out[a:b] = (total[e] - total[s]) * _powers("down", hi - lo)[s] + (e - s).astype(_U) * _MUL
        return mix(out)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether every word of ``data`` has the bytes of the word whose number ``other`` gives for it."""
    size = end - start
    if (size != size[other]).any():
        return False
    step = 1 << 16
    for k in range(0, len(start), step):
        many = size[k : k + step]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        if (data[at + np.repeat(start[k : k + step], many)] != data[at + np.repeat(start[other[k : k + step]], many)]).any():
            return False
    return True


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k words; empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    total = words[:n] * _MUL
    for j in range(1, k):
        total = (total ^ (total >> _U(29))) * _MIX1 + words[j : j + n]
    return mix(total)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text is one shingle as a whole."""
    if len(words) == 0:
        return np.zeros(0, dtype=_U)
    return np.unique(shingles(words, k if len(words) >= k else len(words)) + _U(max(0, k - len(words))))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def as_word(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(_U)


def ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array for each row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    if parts:
        np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
