"""Arrays packed into binary values, and dealing by bucket."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    raw = [np.ascontiguousarray(a) for a in arrays]
    head = struct.pack(f"<{len(raw)}q", *(a.nbytes for a in raw))
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in raw))


def _unpack(blob: bytes | memoryview, *kinds: str) -> list[np.ndarray]:
    import zstandard

    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", blob), 0, []
    raw = zstandard.ZstdDecompressor().decompress(blob[8 * len(kinds) :], max_output_size=max(1, sum(sizes)))
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _split(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) of each bucket in use, indices ascending."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in range(n):
        if ends[k] < ends[k + 1]:
            yield k, order[ends[k] : ends[k + 1]]
