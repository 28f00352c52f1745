"""Top-k search: exact, and by a budget of leaves with paging.

A best-first walk pops the cheapest open node. Seen from a leaf with path costs
d1..dL, only the suffix maxima of the path decide when it is popped, so ordering
leaves by them gives the walk's order for all queries at once, without a queue.

Queries come in blocks of a bounded size and are sent to the workers. Tasks
score leaves and items by matrix products and pass on no more than a query can
use: the leaves of its budget, and its k best items. Where a budget holds too few
items, only the queries in need ask again with twice the budget. Budgets of many
leaves travel as the place of their last leaf (``visits.py``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import NO_ID, Best, Metric, best_pairs, cost, cost_matrix, row_costs, value_matrix
from ..plans.index import VectorIndex
from ..sources.scratch import settle
from .assign import matrix, spread
from .visits import Asked, Tree, ends, sort_keys

#: Queries are sent to the workers in blocks of about so many.
QUERY_BLOCK = 10_000
#: Leaves of a saved index are named in the scan's filter up to this number.
NAMED_LEAVES = 1_000
#: Pairs of query and leaf that are sent to the workers; beyond, the ends of budgets are.
SENT_PAIRS = 1_000_000
#: Scores of all pairs: how many a task makes (about 1 GB written), and holds.
TASK_PAIRS, HELD_PAIRS = 100_000_000, 1_000_000
#: Items that a task of a session holds.
TABLE_BYTES = 512 * 1024 * 1024


def _check(k: int, search_exp: int = 1) -> None:
    if k < 1 or search_exp < 1:
        raise ValueError("k and search_exp must be at least 1")


def _blocks(queries: DataFrame) -> list[tuple[Asked, DataFrame]]:
    """The queries in blocks of a bounded size, on the driver and as a table."""
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("qv").cast("array<float>").alias("qv"))
    first = asked.limit(QUERY_BLOCK + 1).toArrow()
    if first.num_rows <= QUERY_BLOCK:
        return [(Asked.of(first), asked)]
    n = -(-asked.count() // QUERY_BLOCK)
    parts = [asked.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == k) for k in range(n)]
    return [(Asked.of(p.toArrow()), p) for p in parts]


def _in_blocks(queries: DataFrame, run: Callable[[Asked, DataFrame], DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [run(*x) for x in _blocks(queries)])


def _found(batch: pa.RecordBatch, asked: Asked, query: np.ndarray, row: np.ndarray, value: np.ndarray, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(asked.ids[query], pa.int64()), batch.column(0).take(pa.array(row)), pa.array(value, pa.float64())], names=names)


def _ranked(pairs: DataFrame, k: int | None, *order: str) -> DataFrame:
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    ranked = ranked if k is None else ranked.filter(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def brute_force(vectors: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "L2") -> DataFrame:
    """``qid, rank, item_id, dist`` of the exact k nearest; ``dist`` is the cost
    (similarities negated), ties by identifier. Each task keeps the best k of a
    query among its vectors, however many batches it reads."""
    _check(k)
    metric = Metric.parse(metric)

    def block(asked: Asked, _: DataFrame) -> DataFrame:
        sent = vectors.sparkSession.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(metric, sent.value.vectors, k)
            for batch in batches:
                if batch.num_rows and len(sent.value.ids):
                    best.add(_numbers(batch.column(0)), matrix(batch.column(1)))
            yield _kept(best, sent.value)

        return spread(vectors.select("item_id", "embedding")).mapInArrow(run, "qid bigint, item_id bigint, dist double")

    return _ranked(_in_blocks(queries, block), k, "dist", "item_id").select("qid", "rank", "item_id", "dist")


def all_scores(vectors: DataFrame, queries: DataFrame, metric: str | Metric) -> DataFrame:
    """``qid, item_id, value``: the metric's value for every pair. Vectors are
    dealt over tasks of about ``TASK_PAIRS`` pairs, and a task holds ``HELD_PAIRS``
    of them at a time; no pair moves."""
    metric = Metric.parse(metric)
    dealt = spread(vectors.select("item_id", "embedding"), vectors.count() * queries.count() // TASK_PAIRS)

    def block(asked: Asked, _: DataFrame) -> DataFrame:
        sent = vectors.sparkSession.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = sent.value
            if not len(q.ids):
                return
            step = max(1, HELD_PAIRS // len(q.ids))
            for whole in batches:
                for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                    value = value_matrix(metric, matrix(batch.column(1)), q.vectors)
                    row, query = np.divmod(np.arange(value.size), len(q.ids))
                    yield _found(batch, q, query, row, value.ravel(), ("qid", "item_id", "value"))

        return dealt.mapInArrow(run, "qid bigint, item_id bigint, value double")

    return _in_blocks(queries, block)


# ---- leaves


def leaf_paths(index: VectorIndex) -> DataFrame:
    """``leaf, centroids`` (from the first level down, one after the other) of
    leaves with items, and ``n``, how many."""
    return index.paths.join(index.leaf_sizes, "leaf").select("leaf", "n", "centroids")


def visit_order(index: VectorIndex, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """``qid, leaf, key, leaf_rank``, and ``n``, the leaf's items: the order in
    which a walk visits leaves, or its first ``limit``. Of equal costs the
    smaller leaf comes first."""
    return _in_blocks(queries, lambda asked, _: _visits(index, asked, limit))


def _visits(index: VectorIndex, asked: Asked, limit: int | None) -> DataFrame:
    metric, levels = Metric.parse(index.config.metric), index.config.levels
    sent = index.nodes.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for whole in batches:
            if not len(q.ids):
                return
            step = max(1, 1_000_000 // len(q.ids) // levels)
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                leaf = batch.column(0).to_numpy()
                path = matrix(batch.column(2)).reshape(len(leaf), levels, -1)
                key = sort_keys([cost_matrix(metric, q.vectors, path[:, level]) for level in range(levels)])
                if limit is None or len(leaf) <= limit:
                    query, row = np.divmod(np.arange(len(q.ids) * len(leaf)), len(leaf))
                else:
                    edge = np.partition(key[0], limit - 1, axis=1)[:, limit - 1 : limit]
                    query, row = np.nonzero(key[0] <= edge)
                    order = np.lexsort((leaf[row], *(key[level, query, row] for level in range(levels - 1, -1, -1)), query))
                    first = np.searchsorted(query, np.arange(len(q.ids)))
                    order = order[np.arange(len(order)) - first[query[order]] < limit]
                    query, row = query[order], row[order]
                keys = key[:, query, row].T
                used = np.isfinite(keys)
                ends = np.concatenate([[0], np.cumsum(used.sum(1))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.ids[query], pa.int64()), batch.column(0).take(pa.array(row)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[used])), batch.column(1).take(pa.array(row))],
                    names=["qid", "leaf", "key", "n"],
                )

    scored = leaf_paths(index).mapInArrow(run, "qid bigint, leaf bigint, key array<double>, n bigint")
    return _ranked(scored, limit, "key", "leaf").select("qid", "leaf", "key", F.col("rank").alias("leaf_rank"), "n")


def leaf_budget(index: VectorIndex, percent: int) -> int:
    """How many leaves ``percent`` % of those with items are, rounded up; a
    budget that grows with the table, so that recall doesn't fall."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    return max(1, -(-percent * index.leaf_sizes.count() // 100))


def _left(index: VectorIndex, order: DataFrame, exclude: DataFrame | None) -> DataFrame:
    """``order`` with ``n`` less the items that are excluded."""
    if exclude is None:
        return order
    keys = ["qid", "leaf"] if "qid" in exclude.columns else ["leaf"]
    out = exclude.select(*keys[:-1], "item_id").distinct()
    gone = out.join(index.items.select("item_id", "leaf"), "item_id").groupBy(*keys).agg(F.count("*").alias("gone"))
    return order.join(gone, keys, "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0))).drop("gone")


# ---- search


def _budgeted(index: VectorIndex, asked: Asked, k: int, search_exp: int, exclude: DataFrame | None, max_increments: int) -> DataFrame:
    """``qid, leaf``: the leaves of each query's first budget search_exp * 2**i
    with k items, or the last one allowed."""
    order = _left(index, _visits(index, asked, search_exp), exclude)
    if max_increments == 0:
        return order.select("qid", "leaf")
    done, i, leaves = [], 0, index.leaf_sizes.count()
    while True:
        order = settle(order.select("qid", "leaf", "n"), "visits")
        if max_increments == i or search_exp << i >= leaves:
            done.append(order)
            break
        short = order.groupBy("qid").agg(F.sum("n").alias("n")).filter(F.col("n") < k).select("qid").toArrow().column("qid")  # at most a block
        done.append(order.join(F.broadcast(order.sparkSession.createDataFrame(pa.table({"qid": short}))), "qid", "left_anti") if len(short) else order)
        if not len(short):
            break
        again = np.isin(asked.ids, short.to_numpy())
        asked, i = Asked(asked.ids[again], asked.vectors[again]), i + 1
        order = _left(index, _visits(index, asked, search_exp << i), exclude)
    return reduce(DataFrame.union, done).select("qid", "leaf")


def search(index: VectorIndex, queries: DataFrame, k: int, search_exp: int = 64, exclude: DataFrame | None = None, max_increments: int = -1) -> DataFrame:
    """``qid, rank, item_id, dist`` of the k best in the first ``search_exp``
    leaves; the budget doubles, ``max_increments`` times at most (-1: no bound),
    until k items are found. ``exclude`` holds ``item_id``, or ``qid, item_id``."""
    _check(k, search_exp)
    per_query = exclude is not None and "qid" in exclude.columns
    trees: list[Broadcast[Tree]] = []  # sent once, whatever the number of blocks

    def block(asked: Asked, queries: DataFrame) -> DataFrame:
        if len(asked.ids) * search_exp > SENT_PAIRS and not per_query and Tree.fits(index):
            if not trees:
                tree = Tree.of(index, index.leaf_sizes if exclude is None or max_increments == 0 else _left(index, index.leaf_sizes, exclude))
                trees.append(index.nodes.sparkSession.sparkContext.broadcast(tree))
            return _wide(index, trees[0], exclude, asked, k, search_exp, max_increments)
        leaves = _budgeted(index, asked, k, search_exp, exclude, max_increments)
        few = len(asked.ids) * search_exp <= SENT_PAIRS
        pairs = leaves.limit(SENT_PAIRS + 1).toArrow() if few else None
        items = index.items
        if exclude is not None and not per_query:
            items = items.join(exclude.select("item_id").distinct(), "item_id", "left_anti")
        if pairs is None or pairs.num_rows > SENT_PAIRS:
            found = items.join(leaves.join(queries, "qid"), "leaf").select("qid", "item_id", cost(index.config.metric, F.col("embedding"), F.col("qv")).alias("dist"))
        else:
            found = _scored(index, _of_leaves(index, items, pairs.column("leaf").to_numpy()), asked, pairs, None if per_query else k)
        return found

    found = _in_blocks(queries, block)
    if per_query:
        found = found.join(exclude.select("qid", "item_id"), ["qid", "item_id"], "left_anti")
    return _ranked(found, k, "dist", "item_id").select("qid", "rank", "item_id", "dist")


def _wide(index: VectorIndex, tree: Broadcast[Tree], exclude: DataFrame | None, asked: Asked, k: int, search_exp: int, max_increments: int) -> DataFrame:
    """``qid, item_id, dist``: the ``k`` best of each task's items in the budgets.
    Items are dealt by leaf, so that few leaves meet the queries at a time."""
    items = index.items.select("item_id", "leaf", "embedding")
    if exclude is not None:
        items = items.join(exclude.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "leaf", "embedding")
    cores = items.sparkSession.sparkContext.defaultParallelism
    sent = items.sparkSession.sparkContext.broadcast((asked, ends(index, tree, asked, k, search_exp, max_increments)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q, last), t = sent.value, tree.value
        best = Best(t.metric, q.vectors, k)
        for batch in batches:
            ids, of, data = _numbers(batch.column(0)), batch.column(1).to_numpy(), matrix(batch.column(2))
            order = np.argsort(of, kind="stable")
            for mine in (order[at : at + best.step] for at in range(0, len(order), best.step)):
                leaves, group = np.unique(of[mine], return_inverse=True)
                best.add(ids[mine], data[mine], last.within(t, q.vectors, np.searchsorted(t.leaf, leaves)), group)
        yield _kept(best, q)

    return items.repartitionByRange(cores, "leaf", "item_id").mapInArrow(run, "qid bigint, item_id bigint, dist double")


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _kept(best: Best, asked: Asked) -> pa.RecordBatch:
    query, ids, dist = best.rows()
    return pa.RecordBatch.from_arrays([pa.array(asked.ids[query], pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(dist, pa.float64())], names=("qid", "item_id", "dist"))


def _of_leaves(index: VectorIndex, items: DataFrame, leaves: np.ndarray) -> DataFrame:
    """The items of few leaves: stored items are sorted by leaf, so that row
    groups of other leaves are skipped."""
    wanted = np.unique(leaves).tolist()
    if not 0 < len(wanted) <= NAMED_LEAVES:
        return items
    return items.filter(F.col("leaf").isin(wanted) & F.col("leaf").between(wanted[0], wanted[-1]))


def _scored(index: VectorIndex, items: DataFrame, asked: Asked, pairs: pa.Table, k: int | None) -> DataFrame:
    """``qid, item_id, dist`` of the items of each query's leaves, and of every
    batch no more than a query's ``k`` best."""
    metric = Metric.parse(index.config.metric)
    by_id = np.argsort(asked.ids)
    query = by_id[np.searchsorted(asked.ids[by_id], pairs.column("qid").to_numpy())]
    leaf = pairs.column("leaf").to_numpy()
    order = np.argsort(leaf, kind="stable")
    sent = items.sparkSession.sparkContext.broadcast((asked, leaf[order], query[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, leaf, query = sent.value
        for batch in batches:
            ids, of, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), None
            order, found = np.argsort(of, kind="stable"), []
            kinds, begins = np.unique(of[order], return_index=True)
            for x, a, b in zip(kinds.tolist(), begins.tolist(), [*begins[1:].tolist(), len(of)]):
                lo, hi = np.searchsorted(leaf, [x, x + 1])
                if lo < hi:
                    data = matrix(batch.column(2)) if data is None else data
                    mine, who = order[a:b], query[lo:hi]
                    one, row, dist = best_pairs(metric, ids[mine], data[mine], q.vectors[who], k)
                    found.append((who[one], mine[row], dist))
            if not found:
                continue
            who, row, dist = (np.concatenate(x) for x in zip(*found))
            if k is not None:  # a query's best of all its leaves here
                order = np.lexsort((ids[row], dist, who))
                head = np.searchsorted(who[order], who[order])
                order = order[np.arange(len(order)) - head < k]
                who, row, dist = who[order], row[order], dist[order]
            yield _found(batch, q, who, row, dist, ("qid", "item_id", "dist"))

    return items.select("item_id", "leaf", "embedding").mapInArrow(run, "qid bigint, item_id bigint, dist double")


# ---- paging


class SearchSession:
    """The ranked results of a batch of queries, for paging. What pages have
    needed is kept until ``close`` frees it."""

    def __init__(self, make: Callable[[int | None], DataFrame], k: int, pages: int | None = None):
        self.k, self._make, self._pages = k, make, pages
        self._kept: DataFrame | None = None
        self._have = 0

    @property
    def pool(self) -> DataFrame:
        """All rounds, or what ``pages`` pages hold."""
        return self._make(self._pages)

    def page(self, number: int = 0) -> DataFrame:
        """Page ``number`` of ``k``, from 0; short only when all is shown. Where
        later pages than before are asked for, at least twice as many are made."""
        if self._kept is None or (self._pages is None and number >= self._have):
            self.close()
            self._have = max(number + 1, 2 * self._have) if self._pages is None else self._pages
            self._kept = self._make(self._have).persist()
        return self._kept.filter((F.col("rank") > number * self.k) & (F.col("rank") <= (number + 1) * self.k))

    def close(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None


def _rounds(counted: DataFrame, k: int, search_exp: int, max_increments: int) -> DataFrame:
    """``qid, leaf, round``: round 0 is the first budget search_exp * 2**i with
    k items (or the last one allowed), then blocks of search_exp leaves.

    The budget is b * 2**i for the smallest i whose leaves hold k items, that
    is, whose last leaf is not before the first leaf that completes k."""
    so_far = Window.partitionBy("qid").orderBy("leaf_rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("cum", F.sum("n").over(so_far))
    enough = F.min(F.when(F.col("cum") >= k, F.col("leaf_rank"))).over(Window.partitionBy("qid"))
    most = F.count("*").over(Window.partitionBy("qid"))
    need = F.coalesce(enough, most) / search_exp
    steps = F.ceil(F.round(F.log2(F.greatest(need, F.lit(1.0))), 9)).cast("int")
    if max_increments >= 0:
        steps = F.least(steps, F.lit(max_increments))
    budget = (F.pow(F.lit(2.0), steps) * search_exp).cast("bigint")
    placed = counted.withColumn("budget", budget)
    after = F.ceil((F.col("leaf_rank") - F.col("budget")) / search_exp)
    return placed.select("qid", "leaf", F.when(F.col("leaf_rank") <= F.col("budget"), 0).otherwise(after).cast("bigint").alias("round"))


def open_session(index: VectorIndex, queries: DataFrame, k: int, search_exp: int = 64, exclude: DataFrame | None = None, max_increments: int = -1, pages: int | None = None) -> SearchSession:
    """What to page through: all rounds, or ``pages`` pages. All leaves are
    ranked for each query, since paging may reach any of them; items are ranked
    as far as pages need them."""
    _check(k, search_exp)
    per_query = exclude is not None and "qid" in exclude.columns
    items = index.items.select("item_id", "leaf", "embedding")
    if exclude is not None and not per_query:
        items = items.join(exclude.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "leaf", "embedding")

    def by_query(most: int | None) -> DataFrame:
        tree = items.sparkSession.sparkContext.broadcast(Tree.of(index, _left(index, index.leaf_sizes, exclude)))
        return _in_blocks(queries, lambda asked, _: _paged(tree, items, asked, k, search_exp, max_increments, most))

    def joined(most: int | None) -> DataFrame:
        rounds = _rounds(_left(index, visit_order(index, queries), exclude), k, search_exp, max_increments)
        found = items.join(rounds.join(queries, "qid"), "leaf").select("qid", "round", "item_id", cost(index.config.metric, F.col("embedding"), F.col("qv")).alias("dist"))
        if per_query:
            found = found.join(exclude.select("qid", "item_id"), ["qid", "item_id"], "left_anti")
        return _ranked(found, most, "round", "dist", "item_id").select("qid", "rank", "item_id", "dist")

    whole = not per_query and Tree.fits(index) and index.leaf_sizes.agg(F.sum("n")).first()[0] * (4 * index.dim + 16) <= TABLE_BYTES
    return SearchSession(lambda shown: (by_query if whole else joined)(None if shown is None else shown * k), k, pages)


def _paged(tree: Broadcast[Tree], items: DataFrame, asked: Asked, k: int, search_exp: int, max_increments: int, most: int | None) -> DataFrame:
    """``qid, rank, item_id, dist`` of all rounds, or of the first ``most`` items
    of each query. A task for each core reads all items, which are dealt to each,
    and ranks them for its part of the queries: no pair of query and item moves."""
    starts = asked.starts()
    numbers = len(starts) - 1
    parts = max(1, min(numbers, items.sparkSession.sparkContext.defaultParallelism))
    sent = items.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, t = sent.value, tree.value
        held = [x for x in batches if x.num_rows]
        if not numbers or not held:
            return
        table = pa.Table.from_batches(held)
        part, of = table.column("part")[0].as_py(), table.column("leaf").to_numpy()
        by_leaf = np.argsort(of, kind="stable")
        begins = np.searchsorted(of[by_leaf], t.leaf)
        sizes = np.searchsorted(of[by_leaf], t.leaf, side="right") - begins
        data, ids = matrix(table.column("embedding")), _numbers(table.column("item_id").combine_chunks())
        for number, key in t.keys_of(q, starts, range(part * numbers // parts, (part + 1) * numbers // parts)):
            leaf = np.tile(np.arange(len(t.leaf)), key.shape[1] // len(t.leaf))
            order = np.lexsort((leaf, *key[::-1]))
            round_, order = _rounds_of(t.n[leaf[order]], order, k, search_exp, max_increments, most)
            found, found_round, found_dist = [], [], []
            for row in range(starts[number + 1] - starts[number]):
                mine = order // len(t.leaf) == row
                at, size = begins[leaf[order[mine]]], sizes[leaf[order[mine]]]
                place = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
                found.append(by_leaf[place])
                found_round.append(np.repeat(round_[mine], size))
                found_dist.append(row_costs(t.metric, q.vectors[starts[number] + row], data, found[-1]))
            rows, dist = np.concatenate(found), np.concatenate(found_dist)
            best = np.lexsort((ids[rows], dist, np.concatenate(found_round)))[:most]
            for at in range(0, len(best), 100_000):
                some = best[at : at + 100_000]
                mine = ids[rows[some]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), q.ids[starts[number]]), pa.int64()), pa.array(np.arange(at + 1, at + 1 + len(some)), pa.int64()), pa.array(mine, pa.int64(), mask=mine == NO_ID), pa.array(dist[some], pa.float64())],
                    names=("qid", "rank", "item_id", "dist"),
                )

    dealt = items.select("item_id", "leaf", "embedding", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartitionById(parts, "part")
    return dealt.mapInArrow(run, "qid bigint, rank bigint, item_id bigint, dist double")


def _rounds_of(n: np.ndarray, order: np.ndarray, k: int, search_exp: int, max_increments: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The rounds (see ``_rounds``) of leaves in their order, with ``n`` items
    each, and the leaves: all of them, or those of the rounds that the first
    ``most`` items are in."""
    so_far, i = np.cumsum(n), 0
    need = min(int(np.searchsorted(so_far, k)) + 1, len(n))
    while search_exp << i < need and i != max_increments:
        i += 1
    budget = search_exp << i
    rank = np.arange(1, len(n) + 1)
    rounds = np.where(rank <= budget, 0, -((budget - rank) // search_exp))
    if most is not None:
        last = rounds[min(int(np.searchsorted(so_far, most)), len(n) - 1)]
        shown = int(np.searchsorted(rounds, last, side="right"))
        rounds, order = rounds[:shown], order[:shown]
    return rounds, order


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``qid, recall``: the share of the exact results that were found."""
    hits = exact.select("qid", "item_id").join(found.select("qid", "item_id", F.lit(1).alias("hit")), ["qid", "item_id"], "left")
    return hits.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
