"""Words of texts as 64-bit hashes, whole texts at a time.

A word's hash is a polynomial of its bytes' random values modulo 2^64. Differences of one running sum over the text
give those of all words at once, so no word becomes a Python object and nothing is remembered between texts.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are read in pieces of so many bytes, cut at spaces, so that a very long text takes bounded memory.
PIECE = 1 << 19

_values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, at least n of them."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, PIECE + (1 << 12)), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key]


class Splitter:
    """Splits UTF-8 texts into words at the given bytes; A-Z count as a-z."""

    def __init__(self, spaces: bytes):
        self.is_space = np.zeros(256, bool)
        self.is_space[list(spaces)] = True
        self.value = _values.copy()
        self.value[65:91] = self.value[97:123]

    def _piece(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        space = np.ones(n + 2, bool)
        space[1:-1] = self.is_space[data]
        edges = np.flatnonzero(space[1:] != space[:-1])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * _power(BASE, n)[:n], out=sums[1:])
        starts = edges[0::2]
        return mix((sums[edges[1::2]] - sums[starts]) * _power(INVERSE, n)[starts])

    def __call__(self, text: bytes) -> np.ndarray:
        """Hashes of the text's words, in order."""
        if not text:
            return np.zeros(0, np.uint64)
        data = np.frombuffer(text, np.uint8)
        if len(data) <= PIECE:
            return self._piece(data)
        out, at = [], 0
        while at < len(data):
            end = at + PIECE
            while end < len(data):  # go on to the next space
                gap = np.flatnonzero(self.is_space[data[end : end + 4096]])
                if len(gap):
                    end += int(gap[0])
                    break
                end += 4096
            out.append(self._piece(data[at:end]))
            at = end
        return np.concatenate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shifts and odd multipliers)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the values at the given offsets from each start at which all of them exist."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in offsets:
        out = (out ^ h[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        out = out ^ (out >> np.uint64(29))
    return mix(out)
