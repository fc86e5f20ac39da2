"""Words, lines and word windows of whole texts as 64-bit hashes, computed on Arrow buffers.

A word is a run of bytes outside space and tab..carriage return; all of these are ASCII, so the
bytes of a UTF-8 text can be scanned without decoding. A word's hash is a sum of random values per
byte times powers of an odd number modulo 2**64, taken from one running sum over the text, then
mixed. Two different words, windows or lines share a hash with chance 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space, \\t \\n \\v \\f \\r.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Texts are scanned in groups of about so many bytes; a longer text makes a group of its own.
GROUP_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_ODD = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_ODD[15]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
#: Places in a table of powers; those further on are products of two entries.
_STEP = 1 << 16


def _powers(base: int) -> np.ndarray:
    t = np.full(_STEP, base, np.uint64)
    t[0] = 1
    return np.cumprod(t)


_POWER, _INVERSE_POWER = _powers(_BASE), _powers(_INVERSE)


def _inverse_at(at: np.ndarray) -> np.ndarray:
    """The inverse of the base to these powers."""
    high = int(at.max()) // _STEP + 1 if len(at) else 1
    far = np.cumprod(np.concatenate([[np.uint64(1)], np.full(high, pow(_INVERSE, _STEP, 1 << 64), np.uint64)]))
    return _INVERSE_POWER[at % _STEP] * far[at // _STEP]


def _running_sum(values: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each place, the sum of the values of the bytes before it, times powers of the base."""
    out = np.zeros(len(data) + 1, np.uint64)
    factor = 1
    for a in range(0, len(data), _STEP):
        part = values[data[a : a + _STEP]] * _POWER[: min(_STEP, len(data) - a)]
        np.cumsum(part * np.uint64(factor), out=out[a + 1 : a + 1 + len(part)])
        out[a + 1 : a + 1 + len(part)] += out[a]
        factor = factor * pow(_BASE, _STEP, 1 << 64) % (1 << 64)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Scan:
    """A group of whole texts. ``rows`` are their places in the Arrow column, ``lo``/``hi`` their
    byte ranges in ``data``, ``first``/``last`` their word ranges; ``start``/``end`` are the words'
    byte ranges and ``word`` their hashes."""

    rows: range
    data: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    first: np.ndarray
    last: np.ndarray
    running: np.ndarray

    def span_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges [a, b), the empty range included."""
        h = (self.running[b] - self.running[a]) * _inverse_at(a)
        return mix(h + (b - a).astype(np.uint64) * _ODD[14])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o, d


def scans(column: pa.Array, lower: bool) -> Iterator[Scan]:
    """Scans every text of an Arrow string column, in groups of whole texts."""
    offsets, data = text_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield _scan(range(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j


def _scan(rows: range, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Scan:
    n = len(data)
    lo, hi = offsets[:-1], offsets[1:]
    running = _running_sum(_LOWER if lower else _BYTE, data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    begins = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    full = lo < hi
    begins[lo[full]] = solid[lo[full] + 1]
    ends[hi[full] - 1] = solid[hi[full]]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    word = mix((running[end] - running[start]) * _inverse_at(start) + (end - start).astype(np.uint64) * _ODD[13])
    return Scan(rows, data, lo, hi, start, end, word, np.searchsorted(start, lo), np.searchsorted(start, hi), running)


def window_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbouring words (runs over a text's end included)."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = word[:n] * _ODD[0]
    for k in range(1, size):
        h += word[k : k + n] * _ODD[k]
    return mix(h)


def short_hash(word: np.ndarray) -> np.ndarray:
    """One hash for a whole sequence of fewer words than a window has."""
    h = np.uint64(len(word)) * _ODD[12]
    for k, w in enumerate(word):
        h = h + w * _ODD[k]
    return mix(np.array([h], np.uint64))


def shingle_sets(scan: Scan, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct window hashes) of every text. With fewer words the whole sequence is
    the one shingle; without words the set is empty."""
    every = window_hashes(scan.word, size)
    for row, a, b in zip(scan.rows, scan.first.tolist(), scan.last.tolist(), strict=True):
        if b - a >= size:
            s = np.sort(every[a : b - size + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield row, s[keep]
        elif b > a:
            with np.errstate(over="ignore"):
                yield row, short_hash(scan.word[a:b])
        else:
            yield row, np.zeros(0, np.uint64)
