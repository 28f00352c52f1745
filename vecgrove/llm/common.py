"""Shared plumbing: table access, the shared scratch folder, batch slicing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_dir, settle  # noqa: F401

#: The bytes that separate words: space and TAB..CR, nothing else.
WORD_GAP = r"\x20\x09-\x0D"
#: Text whose derived rows meet in one group of an Arrow step.
PART_BYTES = 16_000_000
#: Hadoop's names of stores that pyarrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What this worker process keeps between tasks for one operator. Asking for
    it drops what other operators have left behind."""
    for other in [k for k in _kept if k != owner]:
        del _kept[other]
    return _kept.setdefault(owner, {})


def release() -> None:
    """Give memory that is free back to the machine, after a step that held much:
    worker processes live on."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def blobs(table: pa.Table) -> list[memoryview]:
    """The binary values of the column ``blob``, without copies."""
    return [memoryview(x.as_buffer()) for x in table.column("blob")]


def filesystem(url: str):
    """(pyarrow filesystem, path in it) for a URI or a local path."""
    from pyarrow import fs

    if "://" not in url and not url.startswith("file:"):
        return fs.LocalFileSystem(), url
    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url.removeprefix("file:").lstrip("/")
    scheme, rest = url.split("://", 1)
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def parts_for(rows: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> int:
    """How many groups to deal work into: so many that each holds what comes of
    about ``part_bytes`` of text, but no fewer than shuffle partitions."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``chars`` bytes of text
    (or one row, if that row alone is longer)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        col = col.cast(pa.large_string())
        size = np.cumsum(pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + chars, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as a list; null counts as empty."""
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def pick(df: DataFrame, carry: bool = False, /, **columns: str) -> DataFrame:
    """Only the named columns, under the given names: ``pick(df, doc_id="id")``,
    and with ``carry`` the whole input row as a struct, ``carried``.

    Operators start with this, so extra columns of the input never clash with
    theirs.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("carried")] if carry else []
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()], *whole)
