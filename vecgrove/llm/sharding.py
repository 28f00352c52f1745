"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size: an offset and a step from its name's hash give a permutation. The shards
take turns, each claiming its next free slot; a shard of weight w takes part in
w turns of every round of the largest weight. A key's hash picks a slot and so
a shard, in constant time. When shards come or go, most keys stay where they
are, and each shard keeps its share of the table to within a slot or so.

The table's size depends on the number of shards alone, never on the data, and
is bounded (``MOST_SLOTS``); it is broadcast to the workers.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Slots for each shard at least, so that shares differ by about 1 %.
SLOTS_PER_SHARD = 100
MOST_SLOTS = 4_000_000


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def table_size(shards: int, per_shard: int = SLOTS_PER_SHARD) -> int:
    """The smallest prime with enough slots."""
    n = max(2, shards * per_shard)
    while not is_prime(n):
        n += 1
    return n


def preference(name: str, size: int) -> tuple[int, int]:
    """(offset, step) of a shard's permutation: offset, offset + step, ..."""
    return zlib.crc32(name.encode()) % size, zlib.crc32(b"step:" + name.encode()) % (size - 1) + 1


def fill(shards: Sequence[str], size: int | None = None, weights: Sequence[int] | None = None) -> list[int]:
    """The lookup table: the shard (its place in ``shards``) of each slot.

    Names must differ; the order of ``shards`` decides who chooses first.
    Weights are turns: a shard of weight 0 gets no slot. ``ValueError`` for no
    shards, repeated names, a size that isn't prime, or no weight at all.
    """
    weights = [1] * len(shards) if weights is None else list(weights)
    if not shards or len(set(shards)) != len(shards) or len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("shards must be named apart and have some weight")
    size = table_size(len(shards)) if size is None else size
    if not is_prime(size):
        raise ValueError(f"{size} is not prime")
    if size > MOST_SLOTS:
        raise ValueError(f"a table of {size} slots is too large to broadcast")
    most, table, left = max(weights), [-1] * size, size
    prefer = [preference(s, size) for s in shards]
    place, due = [p[0] for p in prefer], [0] * len(shards)
    while left:
        for k, (_, step) in enumerate(prefer):
            due[k] += weights[k]
            if due[k] < most:
                continue
            due[k] -= most
            while table[place[k]] >= 0:
                place[k] = (place[k] + step) % size
            table[place[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the table's
    size; null counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(size).cast("bigint")).cast("int")


def assign(df: DataFrame, shards: Sequence[str], key_col: str = "doc_id", size: int | None = None, weights: Sequence[int] | None = None, carry: bool = False) -> DataFrame:
    """One row per input row: ``key`` (the input's), ``slot``, ``shard`` (its
    number) and ``shard_name``, with ``carry`` also the input row as a struct.

    The lookup table is broadcast, so placing needs no shuffle, and no key,
    however common, changes the work of a task. Equal keys
    go to one shard; null keys go where the empty text goes. An empty table
    gives an empty result.
    """
    table = fill(shards, size, weights)
    rows = pick(df, carry, key=key_col)
    placed = rows.withColumn("slot", slot_of(F.col("key"), len(table)))
    slots = df.sparkSession.createDataFrame([(k, x, shards[x]) for k, x in enumerate(table)], "slot int, shard int, shard_name string")
    return placed.join(F.broadcast(slots), "slot", "left").select("key", *(["carried"] if carry else []), "slot", "shard", "shard_name")


def write_sharded(df: DataFrame, shards: Sequence[str], out_dir: str, key_col: str = "doc_id", parts: int = 1) -> None:
    """Write the rows below ``out_dir/shard_name=...``; each shard is dealt to
    ``parts`` tasks by a hash of the row, so that one that holds a third of all
    rows is not one task's work."""
    placed = assign(df, shards, key_col, carry=True)
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("carried"), F.lit(parts)))
    dealt.repartition(len(shards) * parts, "shard", "part").select("shard_name", "carried.*").write.partitionBy("shard_name").mode("overwrite").parquet(out_dir)


def moved(before: Sequence[int], after: Sequence[int], names_before: Sequence[str], names_after: Sequence[str]) -> float:
    """The share of slots whose shard has another name in the new table."""
    if len(before) != len(after):
        raise ValueError("tables of different sizes")
    return sum(names_before[a] != names_after[b] for a, b in zip(before, after)) / len(before)
