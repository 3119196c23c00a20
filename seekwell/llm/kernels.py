"""Vectorised word kernels: whole Arrow batches of texts are cut into words and hashed with numpy.

Words are maximal runs of word bytes.  Both word classes in use separate at ASCII characters only, so
cutting UTF-8 bytes gives the same words as cutting characters.  Hashes are 64-bit and ignore the case
of A-Z; equal words always have equal hashes.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_CHUNK = 1 << 19

_BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
CASED = _BYTES.copy()
_BYTES[65:91] = _BYTES[97:123]

#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = np.ones(256, bool)
ALNUM[0:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
ALNUM[65:91] = True

_pows: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pows
    if len(_pows[0]) < n:
        def of(p: int) -> np.ndarray:
            out = np.full(n, p, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)
        _pows = (of(_P), of(_P_INV))
    return _pows


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def release() -> None:
    """Give memory that a task has freed back to the system: idle workers count towards their executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers release memory after each task."""
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


@dataclass
class Words:
    """Words of a batch. ``bounds[i]:bounds[i+1]`` are those of text i; start and end are byte positions in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def bytes_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_large_binary(texts.type) else b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts, word: np.ndarray, hashed: bool = True, codes: np.ndarray = _BYTES) -> Words:
    """Cut ``texts`` into words; temporary arrays are bounded by about a megabyte of text (and the longest word)."""
    data, offsets = bytes_of(texts)
    n = len(data)
    starts, ends, hashes = [], [], []
    first = offsets[:-1][offsets[:-1] < n]
    last = offsets[1:][offsets[1:] > 0] - 1
    a = 0
    while a < n:
        b = min(n, a + _CHUNK)
        while b < n and word[data[b - 1]]:  # a cut stands after a byte that is in no word
            gap = np.flatnonzero(~word[data[b : b + _CHUNK]])
            b = b + int(gap[0]) + 1 if len(gap) else min(n, b + _CHUNK)
        m = word[data[a:b]]
        before, after = np.zeros_like(m), np.zeros_like(m)
        before[1:], after[:-1] = m[:-1], m[1:]
        before[first[np.searchsorted(first, a) : np.searchsorted(first, b)] - a] = False
        after[last[np.searchsorted(last, a) : np.searchsorted(last, b)] - a] = False
        s, e = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
        starts.append(s + a)
        ends.append(e + a)
        if hashed:
            p, inv = _powers(b - a + 1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(codes[data[a:b]] * p[: b - a], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * inv[s]))
        a = b
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    start = cat(starts, np.int64)
    return Words(data, offsets, start, cat(ends, np.int64), cat(hashes, np.uint64), np.searchsorted(start, offsets))


_MULT = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words; empty if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _MULT[0]
    for j in range(1, k):
        out += h[j : j + n] * _MULT[j]
    return mix(out + np.uint64(k))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; a text of fewer words is one shingle, one without words has none."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    g = np.sort(grams(h, min(k, len(h))))
    return g[np.concatenate(([True], g[1:] != g[:-1]))]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
