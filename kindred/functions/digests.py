"""MD5 of many short texts at once, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Hashes of a block: its six buffers stay in a core's cache.
BLOCK = 32_768


def _first_words(w: list, shape: tuple[int, int]) -> np.ndarray:
    """The first four bytes of the digests of one block each (16 words that broadcast to the shape), as big-endian numbers.

    The first word has its last change in step 61 of 64.
    """
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += w[k] + _SINES[i]
        np.left_shift(f, np.uint32(_TURNS[i]), out=t)
        f >>= np.uint32(32 - _TURNS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(_START[0])
    return b.byteswap()


def _by_length(numbers: np.ndarray, end: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes) of the numbers' texts with their end, by length; one row a text."""
    texts = np.char.add(numbers.astype(np.int64).astype("S20"), end)
    sizes = np.char.str_len(texts)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, texts[at].astype(f"S{n}").view(np.uint8).reshape(len(at), n)


def md5_heads(left: np.ndarray, right: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in left, places in right) of all pairs of whole numbers whose `left/right` has an MD5 that begins with at most `most` of left.

    The first four bytes count, as a big-endian number; most is one such number for each of left.
    """
    tails = list(_by_length(right, b""))
    with np.errstate(over="ignore"):
        for la, names in _by_length(left, b"/"):
            n = names.shape[1]
            heads = np.zeros((len(la), 64), np.uint8)
            heads[:, :n] = names
            heads = heads.view("<u4")
            for ra, ends in tails:
                size = n + ends.shape[1]
                rest = np.zeros((len(ra), 64), np.uint8)
                rest[:, n:size] = ends
                rest[:, size] = 0x80
                rest[:, 56], rest[:, 57] = size * 8 % 256, size * 8 // 256
                rest = rest.view("<u4")
                step = max(1, BLOCK // len(ra))
                for s in range(0, len(la), step):
                    h = heads[s : s + step]
                    w = [h[:, j, None] if 4 * j + 4 <= n else h[:, j, None] | rest[:, j] if 4 * j < n else rest[:, j] if 4 * j <= size else rest[0, j] for j in range(16)]
                    x, y = np.nonzero(_first_words(w, (len(h), len(ra))) <= most[la[s : s + step], None])
                    yield la[s + x], ra[y]
