"""Words, hashes and window minima of Arrow text columns, over whole numpy arrays at once.

Texts are handled as UTF-8 bytes. A word is a maximal run of bytes of a class; since both classes
used here hold every byte of 0x80 and above, runs of bytes are runs of code points. Word hashes have
64 bits and depend on the word's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True

SLICE_BYTES = 1 << 20
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _CHUNK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 1)
_SUM = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_POW[:-1])])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Words(NamedTuple):
    """Words of some rows: row i has words first[i] up to first[i + 1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, a: int, b: int, sep: bytes = b" ") -> bytes:
        """Words a up to b, joined."""
        raw = self.buf.data
        return sep.join([bytes(raw[s:e]) for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each row starts (one more at the end)."""
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[bounds[0] : bounds[-1]], bounds - bounds[0]


def tokenize(texts: pa.Array, kind: np.ndarray, lower: bool = False) -> Words:
    buf, bounds = raw(texts)
    if lower:
        buf = _translated(buf, LOWER)
    start, end = _edges(_translated(buf, kind), bounds)
    first = np.searchsorted(start, bounds).astype(np.int64)
    return Words(buf, start, end, first, _word_hashes(buf, start, end))


def _translated(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[buf]``, without an index of eight bytes for each byte."""
    return np.frombuffer(buf.tobytes().translate(table.tobytes()), table.dtype)


def _edges(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.empty(len(inside), bool)
    new[0] = True
    np.logical_not(inside[:-1], out=new[1:])
    new[bounds[:-1][bounds[:-1] < len(inside)]] = True
    last = np.empty(len(inside), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[bounds[1:][bounds[1:] > 0] - 1] = True
    return np.flatnonzero(inside & new), np.flatnonzero(inside & last) + 1


def _word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    size = end - start
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + _CHUNK, side="right"))
        if j <= i:
            out[i] = _long_hash(buf[start[i] : end[i]])
            i += 1
            continue
        at, to = start[i], end[j - 1]
        run = np.zeros(to - at + 1, np.uint64)
        np.multiply(buf[at:to], _POW[: to - at], out=run[1:])
        np.cumsum(run[1:], out=run[1:])
        a = start[i:j] - at
        # each byte counts as one more than it is
        out[i:j] = (run[end[i:j] - at] - run[a]) * _INV[a] + _SUM[size[i:j]]
        i = j
    return mix(out + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _long_hash(word: np.ndarray) -> np.uint64:
    """The same value as for short words, block by block."""
    total, scale = 0, 1
    for at in range(0, len(word), _CHUNK):
        part = word[at : at + _CHUNK].astype(np.uint64) + np.uint64(1)
        total += scale * int(np.sum(part * _POW[: len(part)], dtype=np.uint64))
        scale = scale * pow(_BASE, _CHUNK, 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text; a longer text is a range of its own."""
    _, bounds = raw(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, j
        i = j


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The hash of k words from each word on; rows are not minded, see ``whole``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for j in range(k):
        out *= _GRAM
        out += hashes[j : j + n]
    return mix(out)


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """Whether k words from each word on lie in its row; as long as ``grams``."""
    n = max(0, int(first[-1]) - k + 1)
    ok = np.ones(n, bool)
    for j in range(1, k):
        at = first[1:] - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def window_argmin(values: np.ndarray, w: int, then: np.ndarray | None = None) -> np.ndarray:
    """Where the smallest value of each w consecutive ones lies, the leftmost of equal ones.

    ``then`` decides among equal values before the place does.
    """
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        less = values[b] < values[a]
        if then is not None:
            less |= (values[b] == values[a]) & (then[b] < then[a])
        return np.where(less, b, a)

    at, span = np.arange(len(values)), 1
    while span * 2 <= w:
        at = better(at[:-span], at[span:])
        span *= 2
    return better(at[:n], at[w - span : w - span + n]) if span < w else at[:n]
