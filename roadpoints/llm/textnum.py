"""Words, word hashes and n-gram hashes of whole texts as numpy arrays, without a Python loop over words.

All functions take texts as one byte buffer with offsets, as Arrow holds them. Hashes are polynomials over wrapping
64-bit integers, finished by a mixing step: equal words have equal hashes on every machine and in every batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as longer texts come."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            up, down = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_BYTES, _WORDS = Powers(_BASE), Powers(_STEP)


def _table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    value = np.arange(1, 257, dtype=np.uint64)
    if lower:
        value[65:91] += np.uint64(32)
    return is_word, value


SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: ``[^\x20\x09-\x0D]+``, and the same with A-Z lower-cased
PLAIN, LOWER = _table(SPACES, False), _table(SPACES, True)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: lower-case letters, digits and all bytes above 0x7F
ALNUM = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null becomes an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range of its own. Bounds the memory, drops nothing."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """The words of texts ``i..j``: byte spans, hashes, and ``first[d]`` the number of the first word of text ``d``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, kind: tuple[np.ndarray, np.ndarray]):
        is_word, value = kind
        at = offsets[i:j + 1] - offsets[i]
        data = data[offsets[i]:offsets[j]]
        m = is_word[data]
        before, after = np.empty_like(m), np.empty_like(m)
        if len(m):
            before[1:], before[0] = m[:-1], False
            after[:-1], after[-1] = m[1:], False
            inner = at[(at > 0) & (at < len(m))]
            before[inner], after[inner - 1] = False, False
        self.data, self.at = data, at
        self.start, self.end = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        up, down = _BYTES.get(len(data) + 1)
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * up[:len(data)], out=c[1:])
        self.hash = mix((c[self.end] - c[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * _M2)
        self._sum = None

    def gram(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word runs ``begin..end`` (numbers of words)."""
        up, down = _WORDS.get(len(self.hash) + 1)
        if self._sum is None:
            self._sum = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(self.hash * up[:len(self.hash)], out=self._sum[1:])
        return mix((self._sum[end] - self._sum[begin]) * down[begin] + (end - begin).astype(np.uint64) * _M1)

    def text(self, begin: int, end: int) -> str:
        """Words ``begin..end`` with A-Z lower-cased, joined by spaces."""
        return b" ".join(self.data[self.start[k]:self.end[k]].tobytes() for k in range(begin, end)).lower().decode("utf-8", "replace")


_STOPS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def line_edges(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where lines begin in the texts that begin at ``at`` (with their end): after line feeds, and after a sentence end and a space."""
    stop = np.flatnonzero(_STOPS[data[:-1]] & (data[1:] == 0x20)) + 2 if len(data) > 1 else np.zeros(0, np.int64)
    return np.unique(np.concatenate([at, np.flatnonzero(data == 0x0A) + 1, stop]))
