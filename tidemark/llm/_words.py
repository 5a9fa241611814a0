"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
#: Fixed random multipliers; changing them changes every hash.
_BASE, _GRAM, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_BYTES = np.random.Generator(np.random.PCG64(20250101)).integers(0, 2**64, 256, dtype=np.uint64)

#: Bytes of words that end at ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words of digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _M1
    h ^= h >> _U(33)
    h *= _M2
    h ^= h >> _U(33)
    return h


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, _U)
    out[0] = 1
    return np.cumprod(out)


class Words:
    """The words of a list of texts (UTF-8 bytes): hashes in order, and where each text's words begin.

    bounds[i]:bounds[i + 1] are the words of text i.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray, block: int = 1 << 20) -> None:
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        inside = table[raw]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(self.starts, begins)
        self.hashes = np.empty(len(self.starts), _U)
        cuts = np.unique(np.r_[np.searchsorted(self.starts, np.arange(0, len(raw), block)), len(self.starts)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first, last = self.starts[a], self.ends[b - 1]
            letters = raw[first:last][inside[first:last]]
            sizes = self.ends[a:b] - self.starts[a:b]
            offsets = np.cumsum(sizes) - sizes
            place = np.arange(len(letters)) - np.repeat(offsets, sizes)
            values = _BYTES[letters] * _powers(max(64, 1 << int(sizes.max()).bit_length()))[place]
            self.hashes[a:b] = mix(np.add.reduceat(values, offsets))

    def __len__(self) -> int:
        return len(self.hashes)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at each word but the last n - 1."""
    if len(hashes) < n:
        return np.empty(0, _U)
    whole, size, part, at = None, 0, hashes, 1
    while True:  # doubling: part holds runs of `at` words, whole those of the low bits of n
        if n & at:
            whole, size = (part, at) if whole is None else (whole[: len(hashes) - size - at + 1] + _pow(size) * part[size : size + len(hashes) - size - at + 1], size + at)
        if at * 2 > n:
            return mix(whole)
        part = part[: len(part) - at] + _pow(at) * part[at:]
        at *= 2


def _pow(n: int) -> np.uint64:
    return _U(pow(int(_GRAM), n, 1 << 64))


def within(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of the runs of n words (see grams), which lie in one text."""
    good = np.ones(max(0, total - n + 1), bool)
    for cut in bounds[1:-1]:
        good[max(0, cut - n + 1) : cut] = False
    return good
