"""Rolling hashes over bytes with numpy; small helpers that run inside tasks.

A string's hash is a polynomial over random odd 64-bit codes of its bytes, modulo 2**64. Sums of prefixes give
the hash of every substring by two array reads and one product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_MASK = (1 << 64) - 1


def mix(z: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    z = z ^ (z >> U(30))
    z = z * U(0xBF58476D1CE4E5B9)
    z = z ^ (z >> U(27))
    z = z * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


class Rolling:
    """Hashes of substrings of arrays of up to ``size`` bytes (or other small codes)."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
        base = int(rng.integers(1 << 60, 1 << 63)) * 2 + 1 & _MASK
        self.up = powers(base, size + 1)
        self.down = powers(pow(base, -1, 1 << 64), size + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of data[start:end], the length included."""
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more entry than rows; null is empty)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    rest = width - span
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PIECE = 1 << 20
_WORDS = Rolling(31, PIECE)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of all rows, in order; A-Z count as a-z. Works in pieces of about ``PIECE`` bytes, cut between words."""
    rows, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, U)], 0
    limits = np.zeros(len(data) + 1, dtype=bool)
    limits[offsets] = True
    while at < len(data):
        stop = min(at + PIECE, len(data))
        while stop < len(data):  # back to a gap between words, or on to the next one
            near = np.flatnonzero(_BLANK[data[at:stop]] | limits[at:stop])
            if len(near) and near[-1] > 0:
                stop = at + int(near[-1])
                break
            stop = min(stop + PIECE, len(data))
        x = data[at:stop]
        full = ~_BLANK[x]
        edge = limits[at:stop]
        begin = np.flatnonzero(full & np.r_[True, ~full[:-1] | edge[1:]])
        end = np.flatnonzero(full & np.r_[~full[1:] | edge[1:], True]) + 1
        roll = _WORDS if len(x) <= PIECE else Rolling(31, len(x))
        hashes.append(roll.hashes(roll.sums(_LOWER[x]), begin, end))
        rows.append(np.searchsorted(offsets, begin + at, side="right") - 1)
        at = stop
    return np.concatenate(rows), np.concatenate(hashes)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of one text; a shorter text is one n-gram."""
    k = min(size, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    out = np.full(n, U(k))
    for i in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + words[i:i + n])
    return np.unique(out)
