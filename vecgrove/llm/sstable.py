"""Token ids as sorted-string-table shards.

A shard holds documents in ascending key order: data blocks with
prefix-compressed keys, a sparse block index (last key, offset and length of
each block), a Bloom filter over the keys, and a fixed-size footer. A lookup
asks the Bloom filter, binary-searches the block index and reads one block.

Layout (integers little-endian unless stated)::

    block*   zstd( entry* ), entry = varint shared, varint rest, varint value
             length, key bytes after the shared prefix, value bytes
    bloom    bit array
    index    per block: last key (9 bytes), offset u64, stored length u32
    footer   index offset u64, blocks u64, bloom offset u64, bloom bits u64,
             entries u64, ids u64, id width u32, hashes u32, magic 8 bytes

A key is 9 bytes: 0 for a null identifier or 1 otherwise, then the identifier
big-endian with the sign bit flipped, so that byte order is numeric order.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec
from .common import filesystem, pick, slices, texts

MAGIC = b"VGSSTv01"
_FOOT = struct.Struct("<QQQQQQII8s")
_INDEX = np.dtype([("key", "S9"), ("at", "<u8"), ("size", "<u4")])
#: What the pieces that a worker's young table remembers may take.
PIECE_BYTES = 160_000_000
BLOCK_BYTES, BITS_PER_KEY, HASHES = 64 * 1024, 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: np.ndarray, bits: int, hashes: int = HASHES) -> np.ndarray:
    """Bloom positions (keys x hashes) by double hashing of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        step = (x >> np.uint64(32)) | np.uint64(1)
        return (x[:, None] + step[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


def _bloom_key(key: bytes) -> int:
    return (int.from_bytes(key[1:9], "big") + key[0]) & ((1 << 64) - 1)


class Writer:
    """Streams entries in key order into one shard."""

    def __init__(self, url: str, width: int):
        import zstandard

        self.url, self.width = url, width
        fs, path = filesystem(url)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.block, self.last, self.held = [], b"", 0
        self.index, self.keys, self.at, self.n_ids = [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        key, shared = key_of(doc_id), 0
        if self.block:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        self.block += [_varint(shared), _varint(9 - shared), _varint(len(value)), key[shared:], value]
        self.last, self.held, self.n_ids = key, self.held + len(value) + 12, self.n_ids + len(ids)
        self.keys.append(_bloom_key(key))
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            stored = self.pack(b"".join(self.block))
            self.out.write(stored)
            self.index.append((self.last, self.at, len(stored)))
            self.at += len(stored)
            self.block, self.held = [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS_PER_KEY * len(self.keys)) + 7 & ~7
        bloom = np.zeros(bits, np.uint8)
        bloom[_probes(np.array(self.keys, np.uint64), bits).ravel().astype(np.int64)] = 1
        bloom_at = self.at
        index_at = bloom_at + bits // 8
        self.out.write(np.packbits(bloom).tobytes())
        self.out.write(np.array(self.index, _INDEX).tobytes())
        self.out.write(_FOOT.pack(index_at, len(self.index), bloom_at, bits, len(self.keys), self.n_ids, self.width, HASHES, MAGIC))
        self.out.close()


class Reader:
    """Random access to one shard; holds its index and Bloom filter only."""

    def __init__(self, url: str):
        import zstandard

        fs, path = filesystem(url)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index_at, blocks, bloom_at, self.bits, self.entries, self.n_ids, self.width, self.hashes, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{url} is no shard")
        self.index = np.frombuffer(self.file.read_at(blocks * _INDEX.itemsize, index_at), _INDEX)
        # numpy strips trailing zero bytes of S9 values
        self.lasts = [k.ljust(9, b"\0") for k in self.index["key"].tolist()]
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(self.bits // 8, bloom_at), np.uint8))
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _block(self, n: int) -> Iterator[tuple[int | None, np.ndarray]]:
        buf = self.unpack(self.file.read_at(int(self.index["size"][n]), int(self.index["at"][n])))
        at, key = 0, b""
        while at < len(buf):
            shared, at = _read_varint(buf, at)
            rest, at = _read_varint(buf, at)
            size, at = _read_varint(buf, at)
            key = key[:shared] + buf[at : at + rest]
            at += rest
            yield id_of(key), np.frombuffer(buf, "<u2" if self.width == 2 else "<u4", size // self.width, at)
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for n in range(len(self.index)):
            yield from self._block(n)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier, else an empty list."""
        key = key_of(doc_id)
        if not self.bloom[_probes(np.array([_bloom_key(key)], np.uint64), self.bits, self.hashes).ravel().astype(np.int64)].all():
            return []
        found = []
        for n in range(bisect.bisect_left(self.lasts, key), len(self.lasts)):
            found += [v for k, v in self._block(n) if k == doc_id]
            if self.lasts[n] > key:
                break
        return found


@dataclass(frozen=True)
class Shard:
    url: str
    first_id: int | None
    docs: int
    ids: int
    start: int


def write_shards(df: DataFrame, tokenizer: str, out_dir: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[Shard]:
    """Encode every text, append ``end_id``, and write range-partitioned shards.

    Returns the manifest in key order, one entry a shard (its length follows
    the number of partitions, not of rows). A null text counts as empty (only
    the end id); null identifiers sort first; repeated identifiers are all
    kept, ordered by a hash of their text, and may span shards. An empty table
    gives no shard. Other columns are not read. A task that is run again
    writes under a new name; only the files that the manifest names count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, out, first = codec(tokenizer, 0, PIECE_BYTES), None, None
        end = np.array([end_id], "<i4")
        width = 2 if max(end_id, mine.tok.get_vocab_size()) <= 1 << 16 else 4
        for batch in slices(batches, "text", 2_000_000):
            names, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if out is None:
                first = (names[0], ties[0])
                out = Writer(f"{out_dir}/shard-{uuid.uuid4().hex}.sst", width)
            for name, text in zip(names, texts(batch, "text")):
                out.add(name, np.concatenate([mine.encode(text), end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"url": [out.url], "first_id": pa.array([first[0]], pa.int64()), "tie": pa.array([first[1]], pa.int64()), "docs": [len(out.keys)], "ids": [out.n_ids]})

    rows = pick(df, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(text) tie", "cast(text as string) text")
    made = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").mapInArrow(run, "url string, first_id bigint, tie bigint, docs bigint, ids bigint").collect()
    made.sort(key=lambda r: (r.first_id is not None, r.first_id or 0, r.tie))
    starts = np.cumsum([0, *(r.ids for r in made)]).tolist()
    return [Shard(r.url, r.first_id, r.docs, r.ids, s) for r, s in zip(made, starts)]


def read_shards(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """Every document of the shards: ``doc_id``, ``start`` (ids before it),
    ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit)."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                rows, at, held = ([], [], [], []), shards[n].start, 0
                for name, ids in Reader(shards[n].url).scan():
                    for col, v in zip(rows, (name, at, len(ids), ids.astype("<u4").tobytes())):
                        col.append(v)
                    at, held = at + len(ids), held + 4 * len(ids)
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = ([], [], [], []), 0
                if rows[0]:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, schema)


def lookup(spark: SparkSession, shards: list[Shard], wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` (array<int>) of the wanted identifiers, by binary search:
    the shard by the manifest, the block by the sparse index."""
    firsts = [(s.first_id is not None, s.first_id or 0) for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, Reader] = {}
        for batch in batches:
            names, found = [], []
            for name in batch.column(0).to_pylist():
                key = (name is not None, name or 0)
                n = max(0, bisect.bisect_left(firsts, key) - 1)
                while n < len(shards) and firsts[n] <= key:
                    if n not in open_:
                        if len(open_) > 16:
                            open_.clear()
                        open_[n] = Reader(shards[n].url)
                    for ids in open_[n].get(name):
                        names.append(name)
                        found.append(ids.astype(np.int32))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return pick(wanted, doc_id=id_col).select(F.col("doc_id").cast("bigint")).mapInArrow(run, "doc_id bigint, ids array<int>")
