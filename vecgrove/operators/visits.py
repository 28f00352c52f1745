"""The order in which a best-first walk visits leaves, and where a budget ends.

A budget of many leaves isn't listed leaf by leaf: the first leaves of a query
are those that don't come after its last one, so that one place a query tells
all of them. Tasks take queries in parts and find these places from the tree,
which is sent to the workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric, cost_matrix, level_size
from .assign import BROADCAST_BYTES, matrix

if TYPE_CHECKING:
    from ..plans.index import VectorIndex

#: Keys computed at once.
CELLS = 1_000_000


@dataclass(frozen=True)
class Asked:
    """A block of queries on the driver, by identifier; vectors are rows."""

    ids: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Asked:
        ids = table.column("qid").to_numpy()
        order = np.argsort(ids, kind="stable")
        return Asked(ids[order], matrix(table.column("qv"))[order] if len(ids) else np.empty((0, 0), np.float32))

    def starts(self) -> np.ndarray:
        """Where the rows of each identifier begin, and the end of the last."""
        return np.append(np.flatnonzero(np.diff(self.ids, prepend=self.ids[:1] - 1)), len(self.ids))


def sort_keys(costs: list[np.ndarray]) -> np.ndarray:
    """Sort keys from path costs (a matrix a level, queries by leaves): the
    costs that no later one of the path exceeds, in order; what is left over
    is filled up with -inf, so that the shorter key comes first."""
    out = [costs[-1]]
    for above in costs[-2::-1]:
        counts = above >= out[0]
        longer = [above, *out]
        out = [np.where(counts, x, y) for x, y in zip(longer, [*out, np.float64(-np.inf)])]
    return np.stack(out)


@dataclass(frozen=True)
class Tree:
    """The leaves that hold items (ascending; ``n``, how many) and the nodes above."""

    metric: Metric
    leaf: np.ndarray
    n: np.ndarray
    #: For each level: the places of its nodes' parents in the level above.
    up: list[np.ndarray]
    centroids: list[np.ndarray]

    @staticmethod
    def fits(index: VectorIndex) -> bool:
        levels = range(1, index.config.levels + 1)
        return sum(level_size(n, index.node_size, index.total_clusters) for n in levels) * (4 * index.dim + 24) <= BROADCAST_BYTES

    @staticmethod
    def of(index: VectorIndex, sizes: DataFrame) -> Tree:
        """``sizes``: ``leaf, n``. Call it where the tree ``fits``."""
        last = index.config.levels
        named = index.nodes.select("level", "node", F.coalesce("parent", F.lit(0)).alias("parent"), F.col("centroid").cast("array<float>").alias("centroid"))
        rows = named.filter(F.col("level") == last).join(sizes, F.col("node") == F.col("leaf")).select("node", "parent", "centroid", "n").toArrow()
        above = named.filter(F.col("level") < last).toArrow()
        parts = [above.filter(pa.array(above.column("level").to_numpy() == level)) for level in range(1, last)] + [rows]
        numbers = [x.column("node").to_numpy() for x in parts]
        orders = [np.argsort(x) for x in numbers]
        parents = [x.column("parent").to_numpy()[o] for x, o in zip(parts, orders)]
        up = [np.zeros(len(x), np.int64) if k == 0 else np.searchsorted(numbers[k - 1][orders[k - 1]], x) for k, x in enumerate(parents)]
        centroids = [matrix(x.column("centroid"))[o] if len(o) else np.empty((0, index.dim), np.float32) for x, o in zip(parts, orders)]
        return Tree(Metric.parse(index.config.metric), numbers[-1][orders[-1]], rows.column("n").to_numpy()[orders[-1]], up, centroids)

    def keys(self, asked: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """(level, query, leaf) of the leaves at places ``leaves``."""
        at, costs = leaves, []
        for level in range(len(self.up) - 1, -1, -1):
            used, back = np.unique(at, return_inverse=True)
            costs.insert(0, cost_matrix(self.metric, asked, self.centroids[level][used])[:, back])
            at = self.up[level][at]
        return sort_keys(costs)


    def keys_of(self, asked: Asked, starts: np.ndarray, numbers: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(number, key) for identifiers that follow each other: a column for
        each of the leaves, and for each row where rows share the identifier."""
        every, step = np.arange(len(self.leaf)), max(1, CELLS // max(1, len(self.leaf)) // len(self.up))
        for part in (numbers[k : k + step] for k in range(0, len(numbers), step)):
            base = starts[part[0]]
            key = self.keys(asked.vectors[base : starts[part[-1] + 1]], every)
            for number in part:
                yield int(number), key[:, starts[number] - base : starts[number + 1] - base].reshape(len(key), -1)


def _place(key: np.ndarray, leaf: np.ndarray, b: int) -> int:
    """The ``b``-th of the leaves in order (of ``key``'s columns)."""
    edge = np.partition(key[0], b - 1)[b - 1]
    tied = np.flatnonzero(key[0] == edge)
    order = np.lexsort((leaf[tied], *key[:0:-1, tied]))
    return tied[order[b - 1 - np.count_nonzero(key[0] < edge)]]


def _before(key: np.ndarray, leaf: np.ndarray, last: np.ndarray, last_leaf: np.ndarray) -> np.ndarray:
    """Whether leaves (``key``: level, query, leaf) don't come after a place a
    query (``last``: level, query)."""
    less, same = np.zeros(key.shape[1:], bool), np.ones(key.shape[1:], bool)
    for mine, edge in zip(key, last[:, :, None]):
        less |= same & (mine < edge)
        same &= mine == edge
    return less | (same & (leaf <= last_leaf[:, None])) | (leaf == last_leaf[:, None])


def each_query(index: VectorIndex, tree: Broadcast[Tree], asked: Asked, of: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows from ``of(number of the identifier, key, leaf, n)`` for each
    identifier among the queries, where key has a column for each of the
    leaves (and each row, where rows share the identifier)."""
    spark, starts = index.nodes.sparkSession, asked.starts()
    sent = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, t = sent.value, tree.value
        for batch in batches:
            for number, key in t.keys_of(q, starts, batch.column(0).to_numpy()):
                times = key.shape[1] // max(1, len(t.leaf))
                yield from of(number, key, np.tile(t.leaf, times), np.tile(t.n, times))

    parts = max(1, min(len(starts) - 1, 2 * spark.sparkContext.defaultParallelism))
    return spark.range(0, len(starts) - 1, 1, parts).mapInArrow(run, schema)


@dataclass(frozen=True)
class Ends:
    """The last leaf of each query's budget: its key (level, query) and number."""

    key: np.ndarray
    leaf: np.ndarray

    def within(self, tree: Tree, asked: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """(query, leaf): which of the leaves at places ``leaves`` the budgets hold."""
        return _before(tree.keys(asked, leaves), tree.leaf[leaves], self.key, self.leaf)


def ends(index: VectorIndex, tree: Broadcast[Tree], asked: Asked, k: int, search_exp: int, max_increments: int) -> Ends:
    """Where the first budget search_exp * 2**i with ``k`` items ends, or the
    last one allowed; a row for each row of ``asked``."""
    levels = index.config.levels

    def of(number: int, key: np.ndarray, leaf: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        i = 0
        while True:
            if search_exp << i >= len(leaf):
                last, last_leaf = np.full(levels, np.inf), np.iinfo(np.int64).max
                break
            at = _place(key, leaf, search_exp << i)
            last, last_leaf = key[:, at], leaf[at]
            if i == max_increments or n[_before(key[:, None], leaf, last[:, None], leaf[at : at + 1])[0]].sum() >= k:
                break
            i += 1
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([int(last_leaf)], pa.int64()), pa.array([last.tolist()], pa.list_(pa.float64()))], names=["number", "leaf", "key"])

    found = each_query(index, tree, asked, of, "number bigint, leaf bigint, key array<double>").toArrow()  # a place a query of the block
    order = np.argsort(found.column("number").to_numpy())
    rows = np.repeat(order, np.diff(asked.starts()))
    return Ends(matrix(found.column("key"))[rows].T, found.column("leaf").to_numpy()[rows])
