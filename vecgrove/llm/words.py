"""Vectorised words: offsets and 64-bit fingerprints of a batch of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
#: A random 64-bit value for each byte, from a fixed seed.
_BYTE = np.random.default_rng(20_24).integers(0, 1 << 64, 256, dtype=np.uint64)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_powers = {}


def powers(n: int, base: int = _BASE, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (or those of its inverse)."""
    key = (base, inverse)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        b = pow(base, -1, 1 << 64) if inverse else base
        out, filled = np.ones(size, np.uint64), 1
        with np.errstate(over="ignore"):
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * np.uint64(pow(b, filled, 1 << 64))
                filled *= 2
        have = _powers[key] = out
    return have[:n]


def range_hash(values: np.ndarray, salt: int = 0):
    """A function (begin, end) -> fingerprints of stretches of ``values``: the
    same for equal stretches wherever they lie."""
    n = len(values)
    base = (_BASE + 2 * salt * 0x632BE59BD9B4E019) % (1 << 64) | 1
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(n, base), dtype=np.uint64)])
    back = powers(n + 1, base, inverse=True)

    def of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))

    return of


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes with one space after each text, where each text begins; one
    more entry for the end). Null counts as empty."""
    raw = [x.encode() if x else b"" for x in col.to_pylist()]
    begins = np.cumsum([0, *(len(x) + 1 for x in raw)])
    return np.frombuffer(b" ".join(raw) + b" ", np.uint8), begins


def words(col: pa.Array, lower: bool = False, block: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of every word, words before each text as len(col)+1 offsets).

    Words are maximal stretches without space or TAB..CR; ``lower`` folds A-Z.
    Bytes are worked through in blocks that end at a gap, so that a very long
    text needs no more than a block (or its longest word) at a time.
    """
    data, begins = flat_bytes(col)
    found, counts, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + block)
        while to < len(data) and not _GAP[data[to - 1]]:
            more = np.flatnonzero(_GAP[data[to : to + block]])
            to = to + int(more[0]) + 1 if len(more) else min(len(data), to + block)
        part = data[at:to]
        gap = (part == 32) | ((part >= 9) & (part <= 13))
        edge = np.flatnonzero(np.concatenate([[not gap[0]], gap[1:] != gap[:-1]]))
        if len(edge) % 2:
            edge = np.append(edge, len(part))
        start, end = edge[::2], edge[1::2]
        found.append(range_hash(_BYTE[_LOWER[part]] if lower else _BYTE[part])(start, end))
        counts.append(start + at)
        at = to
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(begins), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(counts), begins)
