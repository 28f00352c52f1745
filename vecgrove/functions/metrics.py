"""Distances as Spark expressions and as one NumPy kernel, and sizing rules."""

from __future__ import annotations

import math
from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest chunk of a dense array, in bytes (fixed value).
CHUNK_BYTES = 50 * 1024 * 1024


class Metric(Enum):
    """How near two vectors are; the codes are stored with an index."""

    L2 = 0
    IP = 1
    COS = 2

    @classmethod
    def parse(cls, name: str | Metric) -> Metric:
        if isinstance(name, cls):
            return name
        try:
            return cls[str(name).upper()]
        except KeyError:
            raise ValueError(f"unknown metric {name!r}; one of {', '.join(m.name for m in cls)}") from None


def _wide(a: Column) -> Column:
    return a.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_wide(a), lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(inner_product(a, b) / size)


def score(metric: str | Metric, a: Column, b: Column) -> Column:
    """The metric's own value: a distance for L2, a similarity otherwise."""
    return {Metric.L2: l2_distance, Metric.IP: inner_product, Metric.COS: cosine_similarity}[Metric.parse(metric)](a, b)


def cost(metric: str | Metric, a: Column, b: Column) -> Column:
    """What searches sort by, ascending: L2, or the negated similarity."""
    value = score(metric, a, b)
    return value if Metric.parse(metric) is Metric.L2 else -value


def cost_matrix(metric: Metric, data: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Costs of data (rows) against nodes (columns), in double precision.

    Rounded to 12 decimals, so that the order of additions inside the matrix
    product doesn't decide between equal nodes.
    """
    data, nodes = data.astype(np.float64), nodes.astype(np.float64)
    dot = data @ nodes.T
    if metric is Metric.L2:
        square = (data * data).sum(1)[:, None] + (nodes * nodes).sum(1)[None, :] - 2 * dot
        return np.round(np.sqrt(np.maximum(square, 0)), 12)
    if metric is Metric.COS:
        size = np.linalg.norm(data, axis=1)[:, None] * np.linalg.norm(nodes, axis=1)[None, :]
        dot = np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)
    return np.round(-dot, 12)


def pair_costs(metric: Metric, a: np.ndarray, b: np.ndarray, which_a: np.ndarray, which_b: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """Costs of the pairs (a[which_a[k]], b[which_b[k]]), from their differences
    for L2, so that small distances are as exact as large ones."""
    out, step = np.empty(len(which_a)), max(1, cells // max(1, a.shape[1]))
    for k in range(0, len(out), step):
        x, y = a[which_a[k : k + step]].astype(np.float64), b[which_b[k : k + step]].astype(np.float64)
        if metric is Metric.L2:
            out[k : k + step] = np.sqrt(((x - y) ** 2).sum(1))
            continue
        dot = (x * y).sum(1)
        if metric is Metric.COS:
            size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
            dot = np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)
        out[k : k + step] = -dot
    return np.round(out, 12)


def value_matrix(metric: Metric, data: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The metric's own values for data (rows) and queries (columns), in double
    precision and not rounded. L2 of rows so near that a matrix product would
    lose digits comes from their differences."""
    a, b = data.astype(np.float64), asked.astype(np.float64)
    value = a @ b.T
    if metric is Metric.IP:
        return value
    if metric is Metric.COS:
        size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
        return np.divide(value, size, out=np.zeros_like(value), where=size > 0)
    both = (a * a).sum(1)[:, None] + (b * b).sum(1)
    value = both - 2 * value
    near = np.nonzero(~(value > 1e-4 * both))
    value = np.sqrt(np.maximum(value, 0))
    value[near] = pair_costs(metric, data, asked, *near)
    return value


def row_costs(metric: Metric, query: np.ndarray, data: np.ndarray, rows: np.ndarray, step: int = 4_000) -> np.ndarray:
    """Costs of one query and ``rows`` of the data, as ``pair_costs`` has them."""
    y, out = query.astype(np.float64), np.empty(len(rows))
    for k in range(0, len(rows), step):
        x = data[rows[k : k + step]].astype(np.float64)
        if metric is Metric.L2:
            out[k : k + step] = np.sqrt(((x - y) ** 2).sum(1))
            continue
        dot = (x * y).sum(1)
        if metric is Metric.COS:
            size = np.linalg.norm(x, axis=1) * np.linalg.norm(y)
            dot = np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)
        out[k : k + step] = -dot
    return np.round(out, 12)


def best_pairs(metric: Metric, ids: np.ndarray, data: np.ndarray, asked: np.ndarray, k: int | None, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``asked``, row of ``data``, cost) of the ``k`` cheapest rows of
    each query, ties by ``ids``; of all rows where ``k`` is None."""
    found = []
    step = max(1 if k is None else 2 * k, cells // max(1, len(asked)))
    for at in range(0, len(data), step):
        part = data[at : at + step]
        if k is None or len(part) <= k:
            query, row = np.divmod(np.arange(len(asked) * len(part)), max(1, len(part)))
        else:
            costs = cost_matrix(metric, asked, part)
            edge = np.partition(costs, k - 1, axis=1)[:, k - 1 : k]
            longest = max(np.abs(x).max(initial=0.0) for x in (asked, part)) * asked.shape[1] ** 0.5
            query, row = np.nonzero(costs <= edge + 1e-6 * (1 + np.abs(edge) + longest))  # more than a matrix product is off
        exact = pair_costs(metric, asked, part, query, row)
        if k is not None:
            order = np.lexsort((ids[at + row], exact, query))
            first = np.searchsorted(query, np.arange(len(asked)))  # queries ascend
            place = np.arange(len(order)) - first[query[order]]
            order = order[place < k]
            query, row, exact = query[order], row[order], exact[order]
        found.append((query, row + at, exact))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


#: Stands for no identifier, and sorts last.
NO_ID = np.iinfo(np.int64).max


def _narrow(metric: Metric, x: np.ndarray, query: bool) -> np.ndarray:
    """Rows in single precision whose products (a query's with an item's) order
    items as their costs do: for L2 the squared length of the item less twice
    the product, for COS of rows of length 1, negated."""
    x = x.astype(np.float64)
    if metric is Metric.L2:
        last = np.ones((len(x), 1)) if query else (x * x).sum(1)[:, None]
        return np.hstack([-2 * x if query else x, last]).astype(np.float32)
    if metric is Metric.COS:
        size = np.linalg.norm(x, axis=1)[:, None]
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    return (-x if query else x).astype(np.float32)


def _off(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """More than a product of rows of ``left`` with any of ``right`` is off, for
    each row of ``left``."""
    size = [np.sqrt(np.square(x, dtype=np.float64).sum(1)) for x in (left, right)]
    return 2e-7 * (left.shape[1] + 8) * size[0] * size[1].max(initial=0.0) + 1e-9


def _upto(rough: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the cells that don't exceed their row's edge."""
    edge = np.nextafter(edge.astype(np.float32), np.float32(np.inf))
    return np.divmod(np.flatnonzero(~(rough > edge[:, None])), max(1, rough.shape[1]))


def nearest_rows(metric: Metric, data: np.ndarray, nodes: np.ndarray, narrow: np.ndarray | None = None, cells: int = 4_000_000) -> np.ndarray:
    """The row of ``nodes`` with the least cost for each row of ``data``, of
    equal ones the first. Products in single precision leave few to compare.
    ``narrow``: the nodes as ``_narrow`` has them."""
    out = np.empty(len(data), np.int64)
    right, left = _narrow(metric, nodes, False) if narrow is None else narrow, _narrow(metric, data, True)
    off, step = 2 * _off(left, right), max(1, cells // max(1, len(nodes)))
    for at in range(0, len(data), step):
        rough = left[at : at + step] @ right.T
        row, node = _upto(rough, rough.min(axis=1) + off[at : at + step])
        exact = pair_costs(metric, data[at : at + step], nodes, row, node)
        order = np.lexsort((node, exact, row))
        out[at : at + step] = node[order][np.searchsorted(row, np.arange(len(rough)))]
    return out


class Best:
    """The ``k`` cheapest items of each query among all that were added, ties by
    identifier; its size depends on the number of queries alone. Products in
    single precision leave out what a query can't use."""

    def __init__(self, metric: Metric, asked: np.ndarray, k: int, cells: int = 4_000_000):
        self.metric, self.asked, self.k = metric, asked, k
        self.step = max(2 * k, cells // max(1, len(asked)))
        self.cost, self.ids = np.full((len(asked), k), np.inf), np.full((len(asked), k), NO_ID)
        self._left = _narrow(metric, asked, True)
        self._square = np.square(asked, dtype=np.float64).sum(1)

    def add(self, ids: np.ndarray, data: np.ndarray, may: np.ndarray | None = None, group: np.ndarray | None = None) -> None:
        """``may[query, group[row]]`` tells which rows count for a query."""
        for at in range(0, len(data), self.step):
            part = slice(at, at + self.step)
            self._part(ids[part], data[part], may, None if may is None else group[part])

    def _part(self, ids: np.ndarray, data: np.ndarray, may: np.ndarray | None, group: np.ndarray | None) -> None:
        right, k = _narrow(self.metric, data, False), self.k
        rough, off, last = self._left @ right.T, _off(self._left, right), self.cost[:, -1]
        edge = (last * last - self._square if self.metric is Metric.L2 else last) + off
        edge += 1e-6 * np.abs(np.where(np.isfinite(edge), edge, 0.0))
        new = np.flatnonzero(np.isinf(last))
        if len(new) and len(data) > k:
            mine = rough[new] if may is None else np.where(may[np.ix_(new, group)], rough[new], np.inf)
            edge[new] = np.partition(mine, k - 1, axis=1)[:, k - 1] + 2 * off[new]
        query, row = _upto(rough, edge)
        if may is not None:
            keep = may[query, group[row]]
            query, row = query[keep], row[keep]
        exact = pair_costs(self.metric, self.asked, data, query, row)
        keep = ~(exact > last[query])
        query, row, exact = query[keep], row[keep], exact[keep]
        who, place = np.unique(query, return_inverse=True)
        if not len(who):
            return
        of = np.concatenate([np.repeat(np.arange(len(who)), k), place])
        cost, ids = np.concatenate([self.cost[who].ravel(), exact]), np.concatenate([self.ids[who].ravel(), ids[row]])
        order = np.lexsort((ids, cost, of))
        first = np.searchsorted(of[order], np.arange(len(who)))
        order = order[np.arange(len(order)) - first[of[order]] < k]
        self.cost[who], self.ids[who] = cost[order].reshape(-1, k), ids[order].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``asked``, identifier or ``NO_ID``, cost)."""
        query, place = np.nonzero((self.ids != NO_ID) | np.isfinite(self.cost))
        return query, self.ids[query, place], self.cost[query, place]


# ---- sizing


def total_clusters(items: int, target_cluster_items: int) -> int:
    return math.ceil(items / target_cluster_items)


def node_size(clusters: int, levels: int) -> int:
    """Children of the root; a floating-point root, as index layouts expect."""
    return math.ceil(clusters ** (1.0 / levels)) if clusters else 0


def level_size(level: int, fan_out: int, clusters: int) -> int:
    return min(fan_out**level, clusters)


def chunk_rows(dim: int, item_bytes: int, most: int = CHUNK_BYTES) -> int:
    """Rows of a chunk of at most ``most`` bytes."""
    rows = most // (dim * item_bytes)
    if rows < 1:
        raise ValueError("one row is larger than a chunk")
    return rows


def memory_bytes(data_rows: int, nodes: int, dim: int, item_bytes: int) -> int:
    """Bytes of a block of data, the nodes and their distances together."""
    return item_bytes * (data_rows * dim + nodes * dim + data_rows * nodes)


def batch_rows(memory_gb: int, dim: int, item_bytes: int) -> int:
    """Rows of a build batch: half of the memory limit."""
    return (memory_gb * 1024**3 // 2) // (dim * item_bytes)
