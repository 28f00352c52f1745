"""A filter over pairs of keys, kept by the workers. It only saves work: it knows
all its keys, and sometimes takes another for one of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import filesystem, kept
from .packed import _pack, _split, _unpack
from .words import mix

#: Cells of the filter, and their largest number as a power of two (128 MB),
#: beyond which there is none.
SEEN_SLICES, CELLS_PER_KEY, MOST_BITS = 32, 16, 30


def _write(out_dir: str, name: str, data: bytes) -> str:
    place = f"{out_dir}/{name}-{uuid.uuid4().hex}"
    fs, path = filesystem(place)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)
    return place


def load_flags(owner: str, made: tuple[int, tuple[tuple[int, str], ...]]) -> np.ndarray:
    """Slices put together, eight cells a byte; kept by this worker for its
    operator ``owner``."""
    loaded = kept(owner)
    if made not in loaded:
        loaded.clear()
        out = np.zeros((SEEN_SLICES, (1 << made[0]) // 8 // SEEN_SLICES), np.uint8)
        for k, place in made[1]:
            fs, path = filesystem(place)
            with fs.open_input_stream(path) as f:
                out[k] = np.frombuffer(f.read(), np.uint8)
        loaded[made] = out.ravel()
    return loaded[made]


def _cells(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return (mix(a.astype(np.uint64) ^ mix(b.astype(np.uint64))) >> np.uint64(64 - bits)).astype(np.int64)


def flagged(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the filter knows each pair of keys (sometimes of one it doesn't)."""
    cell = _cells(a, b, len(table).bit_length() + 2)
    return ((table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)


def flag(keys: DataFrame, out_dir: str) -> tuple[int, tuple[tuple[int, str], ...]] | None:
    """Write a filter over distinct pairs of keys as slices, of a size
    that follows their number; None where it would be too large."""
    bits = max(20, (keys.count() * CELLS_PER_KEY).bit_length())
    if bits > MOST_BITS:
        return None
    per_slice = (1 << bits) // SEEN_SLICES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.unique(_cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits))
            got = [(k, _pack(cell[x].astype("<i4"))) for k, x in _split(cell // per_slice, SEEN_SLICES)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in got], pa.int32()), "blob": pa.array([b for _, b in got], pa.binary())})

    def write(table: pa.Table) -> pa.Table:
        k, bits = table.column("part")[0].as_py(), np.zeros(per_slice, np.uint8)
        for blob in table.column("blob").to_pylist():
            bits[_unpack(blob, "<i4")[0] % per_slice] = 1
        return pa.table({"part": pa.array([k], pa.int32()), "place": [_write(out_dir, f"filter-{k}", np.packbits(bits).tobytes())]})

    made = keys.mapInArrow(deal, "part int, blob binary").groupBy("part").applyInArrow(write, "part int, place string").collect()
    return bits, tuple(sorted((r.part, r.place) for r in made))
