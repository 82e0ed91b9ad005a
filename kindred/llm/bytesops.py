"""Numpy kernels over the UTF-8 bytes of Arrow string columns.

A batch of texts is one byte array with offsets.  Words are runs of a byte class and are
hashed from prefix polynomial hashes (mod 2**64, odd base, finalised by a bit mixer), so
that no Python string is made for a word.  Batches are cut into slices of bounded bytes;
a slice always holds whole texts.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def class_table(excluded: list[tuple[int, int]]) -> np.ndarray:
    """uint8[256]: 1 for bytes outside the excluded inclusive ranges."""
    out = np.ones(256, np.uint8)
    for a, b in excluded:
        out[a : b + 1] = 0
    return out


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = class_table([(0x20, 0x20), (0x09, 0x0D)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z
ALNUM = class_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n (at least)."""
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for k, base in enumerate((BASE, INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64 (in a new array)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """uint64[n+1] of prefix polynomial hashes."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end], the same wherever it stands."""
    inv = powers(len(prefix))[1]
    with np.errstate(over="ignore"):
        raw = (prefix[end] - prefix[start]) * inv[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    else:
        texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, off, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_trimmed = [0.0]


def trim() -> None:
    """Gives freed memory back to the system, now and then: Python workers outlive the stages that filled them."""
    now = time.monotonic()
    if now - _trimmed[0] > 0.3:
        _trimmed[0] = now
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, at least one row each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j
    trim()


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text + total) of the runs of class `kind`; runs end with their text."""
    inside = kind[data].astype(bool)
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        before[cut], after[cut - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


class Memo:
    """A bounded cache from 64-bit hashes to rows of numbers, kept by a Python worker.

    Direct mapped; a miss is computed again, so its size sets speed only, never results.
    """

    def __init__(self, width: int, bits: int = 20, dtype=np.float64) -> None:
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros((1 << bits, width), dtype)
        self.low = np.uint64((1 << bits) - 1)

    def get(self, hashes: np.ndarray, compute) -> np.ndarray:
        """compute(positions): rows for hashes[positions], one for each distinct unknown hash."""
        slot = (hashes & self.low).astype(np.int64)
        out = self.rows[slot]
        missing = np.flatnonzero(self.keys[slot] != hashes)
        if len(missing):
            _, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            rows = compute(missing[first])
            out[missing] = rows[which]
            at = slot[missing[first]]
            self.keys[at], self.rows[at] = hashes[missing[first]], rows
        return out


def run_ids(lengths: np.ndarray) -> np.ndarray:
    """0 0 1 1 1 ... for lengths 2 3 ..."""
    return np.repeat(np.arange(len(lengths)), lengths)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... of every range, one after the other."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = length > 0
    s, n = start[keep].astype(np.int64), length[keep].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    out[0] = s[0]
    return np.cumsum(out)
