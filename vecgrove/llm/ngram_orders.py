"""Interpolated modified Kneser-Ney models of any order.

The n-grams of the highest order are counted by Spark (texts begin with order - 1
begin marks); each lower order counts in how many different n-grams of the order
above its n-grams are the end. Every order is stored as two sets of shards of
sorted fingerprints: its n-grams with their counts, and its contexts with the
sum of their counts and how many are 1, 2 and more. Scoring looks up whole
batches by binary search in the mapped shards, from the lowest order up::

    P1(w)    = max(a(w) - D, 0) / T + gamma / (V + 1)
    Pk(w|h)  = max(a(hw) - D(a), 0) / A(h) + gamma(h) * Pk-1(w|h')
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .common import parts_for, pick, slices
from .packed import _split
from .words import mix

_CONTEXT = np.dtype([("sum", "<i8"), ("n1", "<i8"), ("n2", "<i8"), ("n3", "<i8")])


@dataclass(frozen=True)
class OrderModel:
    """Places of the shards (grams and contexts by order, words with their plain
    counts) and the totals."""

    order: int
    parts: int
    grams: tuple[tuple[str, ...], ...]
    contexts: tuple[tuple[str, ...], ...]
    words: tuple[str, ...]
    tokens: int
    distinct: int
    types: tuple[int, ...]  # different n-grams of each order
    sums: tuple[int, ...]  # of their counts
    counts: tuple[tuple[int, ...], ...]  # n-grams of each order with a count of 1, 2, 3 and 4


def places(begins: np.ndarray) -> np.ndarray:
    """How many tokens of its text come before each token."""
    at = np.arange(len(begins))
    return at - np.maximum.accumulate(np.where(begins, at, 0))


def word_before(tok: np.ndarray, within: np.ndarray, k: int, begin: np.uint64) -> np.ndarray:
    """The k-th token before each, a begin mark where the text has none."""
    return np.where(within >= k, tok[np.maximum(np.arange(len(tok)) - k, 0)], begin)


def gram_key(tok: np.ndarray, within: np.ndarray, size: int, last: int, begin: np.uint64) -> np.ndarray:
    """The fingerprint of the ``size`` tokens up to the ``last``-th before each."""
    key = mix(word_before(tok, within, last, begin))
    for k in range(last + 1, last + size):
        key = join_keys(word_before(tok, within, k, begin), key)
    return key


def join_keys(word: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The fingerprint of an n-gram from its first word and that of the rest."""
    with np.errstate(over="ignore"):
        return mix(mix(word) * np.uint64(0x9FB21C651E98DF25) + key)


def _write(table: DataFrame, names: list[str], values: list[str], parts: int, out_dir: str, label: str) -> tuple[str, ...]:
    """Store a table under the fingerprints of its words ``names``, ascending in
    each shard, with its ``values``."""
    from .kneser_ney import _save, shard_of

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_numpy().astype(np.uint64) for k in range(len(names))]
            key = mix(cols[-1]) if cols else np.zeros(batch.num_rows, np.uint64)
            for c in cols[-2::-1]:
                key = join_keys(c, key)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(key, parts).astype(np.int32)), pa.array(key.astype(np.int64)), *batch.columns[len(names) :]], names=["part", "key", *values])

    def store(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy().astype(np.uint64)
        order = np.argsort(key)
        data = np.stack([table.column(v).to_numpy()[order] for v in values], 1).astype("<i8")
        return pa.table({"part": table.column("part")[:1], "place": [_save(out_dir, label, key[order], data)]})

    rows = table.select(*names, *values).mapInArrow(keyed, "part int, key bigint, " + ", ".join(f"{v} bigint" for v in values))
    made = {r.part: r.place for r in rows.repartition(parts, "part").groupBy("part").applyInArrow(store, "part int, place string").collect()}
    return tuple(made.get(k, "") for k in range(parts))


def train_order(df: DataFrame, out_dir: str, order: int, text_col: str = "text") -> OrderModel:
    """Count the texts of ``df`` and write a model of this order below
    ``out_dir``. A null or empty text is an end alone; an empty table gives an
    empty model."""
    from .kneser_ney import BEGIN, tokens

    if order < 1:
        raise ValueError("the order must be at least 1")
    rows = pick(df, text=text_col).selectExpr("cast(text as string) text")
    parts, all_names = parts_for(rows), [f"w{k}" for k in range(1, order + 1)]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tok, begins, _ = tokens(batch)
            cols = [word_before(tok, places(begins), k, BEGIN).astype(np.int64) for k in range(order - 1, -1, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=all_names)

    level = settle(rows.mapInArrow(grams, ", ".join(f"{n} bigint" for n in all_names)).groupBy(*all_names).agg(F.count("*").alias("a")), "grams")
    words = level.groupBy(F.col(all_names[-1]).alias("w1")).agg(F.sum("a").alias("a"))
    tokens_, distinct = words.agg(F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    made, types, sums, counts = {}, {}, {}, {}
    for k in range(order, 0, -1):
        names = [f"w{j}" for j in range(1, k + 1)]
        of = {r.a: r.n for r in level.filter("a <= 4").groupBy("a").agg(F.count("*").alias("n")).collect()}
        types[k], sums[k] = level.agg(F.count("*"), F.coalesce(F.sum("a"), F.lit(0))).first()
        counts[k] = tuple(of.get(c, 0) for c in (1, 2, 3, 4))
        contexts = () if k == 1 else _write(
            level.groupBy(*names[:-1]).agg(F.sum("a").alias("sum"), F.count_if(F.col("a") == 1).alias("n1"), F.count_if(F.col("a") == 2).alias("n2"), F.count_if(F.col("a") > 2).alias("n3")),
            names[:-1], ["sum", "n1", "n2", "n3"], parts, out_dir, f"contexts-{k}",
        )
        made[k] = (_write(level, names, ["a"], parts, out_dir, f"grams-{k}"), contexts)
        if k > 1:  # in how many different n-grams each shorter one is the end
            shorter = [F.col(f"w{j + 1}").alias(f"w{j}") for j in range(1, k)]
            level = settle(level.groupBy(*shorter).agg(F.count("*").alias("a")), "grams")
    each = range(1, order + 1)
    return OrderModel(
        order, parts, tuple(made[k][0] for k in each), tuple(made[k][1] for k in each), _write(words, ["w1"], ["a"], parts, out_dir, "words"),
        tokens_, distinct, tuple(types[k] for k in each), tuple(sums[k] for k in each), tuple(counts[k] for k in each),
    )


def _values(places: tuple[str, ...], keys: np.ndarray, parts: int, kind: np.dtype) -> np.ndarray:
    """The stored value of every key, zero where there is none."""
    from .kneser_ney import _look_up, shard_of

    distinct, which = np.unique(keys, return_inverse=True)
    out = np.zeros(len(distinct), kind)
    for k, x in _split(shard_of(distinct, parts), parts):
        if (got := _look_up(places[k], distinct[x], kind)) is not None:
            out[x[got[0]]] = got[1][got[0]]
    return out[which]


def order_log10(model: OrderModel, tok: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(token | tokens before), plain count of the token) for a batch."""
    from .kneser_ney import BEGIN, _discount, discounts

    number, n = np.dtype("<i8"), model.parts
    within = places(begins)
    word = gram_key(tok, within, 1, 0, BEGIN)
    d, total = discounts(model.counts[0]), max(1, model.sums[0])
    n1, n2 = model.counts[0][:2]
    left = (d[0] * n1 + d[1] * n2 + d[2] * max(0, model.types[0] - n1 - n2)) / total if model.sums[0] else 1.0
    a = _values(model.grams[0], word, n, number)
    p = (a - _discount(a, d)) / total + left / (model.distinct + 1)
    for k in range(2, model.order + 1):
        d, a = discounts(model.counts[k - 1]), _values(model.grams[k - 1], gram_key(tok, within, k, 0, BEGIN), n, number)
        c = _values(model.contexts[k - 1], gram_key(tok, within, k - 1, 1, BEGIN), n, _CONTEXT)
        some = np.maximum(c["sum"], 1)
        gamma = np.where(c["sum"] > 0, (d[0] * c["n1"] + d[1] * c["n2"] + d[2] * c["n3"]) / some, 1.0)
        p = np.where(c["sum"] > 0, (a - _discount(a, d)) / some, 0.0) + gamma * p
    return np.log10(p), _values(model.words, word, n, number)
