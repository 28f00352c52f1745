"""What an index looks like, and which of its nodes to drop from a cache."""

from __future__ import annotations

import threading
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import cost
from ..plans.index import VectorIndex


def occupancy(index: VectorIndex) -> DataFrame:
    """``leaf, n_items`` for every leaf, empty ones too."""
    leaves = index.nodes.filter(F.col("level") == index.config.levels).select(F.col("node").alias("leaf"))
    return leaves.join(index.leaf_sizes, "leaf", "left").select("leaf", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_items"))


def borders(index: VectorIndex) -> DataFrame:
    """``leaf, border_item, border_cost, n_items``: the item farthest from the
    leaf's centre, of equal ones the smallest."""
    leaves = index.nodes.filter(F.col("level") == index.config.levels).select(F.col("node").alias("leaf"), "centroid")
    far = index.items.join(leaves, "leaf").select("leaf", "item_id", cost(index.config.metric, F.col("embedding"), F.col("centroid")).alias("c"))
    return far.groupBy("leaf").agg(F.max_by("item_id", F.struct("c", (-F.col("item_id")).alias("least"))).alias("border_item"), F.max("c").alias("border_cost"), F.count("*").cast("bigint").alias("n_items"))


def eviction_plan(access: DataFrame, keep: int, node_col: str, time_col: str) -> DataFrame:
    """``node, last_access``: what to drop so that the ``keep`` nodes used last
    stay; of equal times the smaller node goes first."""
    last = access.groupBy(F.col(node_col).alias("node")).agg(F.max(time_col).alias("last_access"))
    kept = last.orderBy(F.col("last_access").desc(), F.col("node").desc()).limit(keep).select("node")
    return last.join(kept, "node", "left_anti").select("node", "last_access")


def preload(index: VectorIndex, levels: int) -> DataFrame:
    """Cache the nodes of the first levels; returns them."""
    if levels > index.config.levels:
        raise ValueError(f"the index has {index.config.levels} levels")
    nodes = index.nodes.filter(F.col("level") <= levels).persist()
    nodes.count()
    return nodes


class NodeCache:
    """Which levels of an index's nodes the executors hold in memory.

    ``prefetch`` levels are fetched in the background from the start; ``load``
    fetches one now. A search reads nodes through ``nodes``: what is held comes
    from memory, the rest from where the index is kept. After a lost executor
    Spark fetches again what it held.
    """

    def __init__(self, index: VectorIndex, prefetch: int = 1):
        if not 0 <= prefetch <= index.config.levels:
            raise ValueError(f"the index has {index.config.levels} levels")
        self.index, self._held, self._lock = index, {}, threading.Lock()
        self._fetching = [threading.Thread(target=self.load, args=(level,), daemon=True) for level in range(1, prefetch + 1)]
        for t in self._fetching:
            t.start()

    def load(self, level: int) -> DataFrame:
        if not 1 <= level <= self.index.config.levels:
            raise ValueError(f"the index has {self.index.config.levels} levels")
        with self._lock:
            if level not in self._held:
                nodes = self.index.nodes.filter(F.col("level") == level).select("*").persist()
                self._held[level] = (nodes, nodes.count())
            return self._held[level][0]

    def wait(self) -> NodeCache:
        """Until all that is fetched in the background is there."""
        for t in self._fetching:
            t.join()
        return self

    def is_loaded(self, level: int) -> bool:
        return level in self._held

    def loaded_nodes(self) -> int:
        """How many nodes are held."""
        return sum(n for _, n in self._held.values())

    @property
    def nodes(self) -> DataFrame:
        """All nodes, the held levels from memory."""
        rest = self.index.nodes.filter(~F.col("level").isin(list(self._held))) if self._held else self.index.nodes
        return reduce(DataFrame.unionByName, (nodes for nodes, _ in self._held.values()), rest)

    def state(self) -> DataFrame:
        """``level, node, loaded``."""
        return self.index.nodes.select("level", "node", F.col("level").isin(list(self._held)).alias("loaded") if self._held else F.lit(False).alias("loaded"))

    def clear(self, level: int | None = None) -> None:
        """Let go of one level, or of all."""
        with self._lock:
            for x in [level] if level is not None else list(self._held):
                if x in self._held:
                    self._held.pop(x)[0].unpersist()
