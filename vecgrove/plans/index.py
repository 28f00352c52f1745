"""Building, keeping and growing a cluster-pruning index."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import Metric, level_size, node_size, total_clusters
from ..operators import representatives as R
from ..operators.assign import descend, spread
from ..sources.embeddings import measure
from ..sources.scratch import settle

INFO = "levels int, metric string, metric_code int, node_size bigint, total_clusters bigint, target_cluster_items bigint, dim int"


@dataclass(frozen=True)
class IndexConfig:
    """``levels`` below the root, wanted items in a leaf, and how to compare."""

    levels: int = 3
    target_cluster_items: int = 100
    metric: str = "L2"
    representatives: str = "offset"
    seed: int = 0

    def __post_init__(self):
        Metric.parse(self.metric)
        if self.levels < 1 or self.target_cluster_items < 1:
            raise ValueError("levels and target_cluster_items must be at least 1")
        if self.representatives not in R.OPTIONS:
            raise ValueError(f"unknown option {self.representatives!r}; one of {', '.join(R.OPTIONS)}")


@dataclass(frozen=True)
class VectorIndex:
    """``reps`` (rep, item_id, embedding); ``nodes`` (level, node, parent,
    centroid), where a leaf is a node of the last level; ``items`` (item_id,
    leaf, embedding)."""

    config: IndexConfig
    dim: int
    node_size: int
    total_clusters: int
    reps: DataFrame
    nodes: DataFrame
    items: DataFrame
    #: ``leaf, n``, one or more rows a leaf that holds items.
    counts: DataFrame
    #: ``leaf, centroids``: each leaf's path from the first level down, flat.
    paths: DataFrame

    @property
    def leaf_sizes(self) -> DataFrame:
        """``leaf, n`` of the leaves that hold items."""
        return self.counts.groupBy("leaf").agg(F.sum("n").alias("n"))

    @property
    def info(self) -> DataFrame:
        c, m = self.config, Metric.parse(self.config.metric)
        row = (c.levels, m.name, m.value, self.node_size, self.total_clusters, c.target_cluster_items, self.dim)
        return self.nodes.sparkSession.createDataFrame([row], INFO)

    def level_sizes(self) -> DataFrame:
        rows = [(n, level_size(n, self.node_size, self.total_clusters)) for n in range(1, self.config.levels + 1)]
        return self.nodes.sparkSession.createDataFrame(rows, "level int, nodes bigint")

    # ---- growing
    def assign(self, vectors: DataFrame) -> DataFrame:
        """``item_id, leaf, embedding`` of new vectors in the unchanged tree."""
        found = descend(vectors, self.nodes, self.config.metric, self.config.levels, carry=True)
        return found.select("item_id", F.col("node").alias("leaf"), "embedding")

    def append(self, vectors: DataFrame) -> VectorIndex:
        new = settle(self.assign(vectors), "items")
        return replace(self, items=self.items.unionByName(new), counts=self.counts.unionByName(count_leaves(new)))

    # ---- keeping
    def save(self, path: str, leaf_files: int | None = None) -> None:
        """Parquet below ``path``; items are dealt and sorted by leaf, so that a
        search reads the row groups of its leaves only."""
        info = self.info.withColumns({"representatives": F.lit(self.config.representatives), "seed": F.lit(self.config.seed)})
        info.coalesce(1).write.mode("overwrite").parquet(f"{path}/info")
        self.reps.write.mode("overwrite").parquet(f"{path}/reps")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.paths.write.mode("overwrite").parquet(f"{path}/paths")
        dealt = self.items.repartitionByRange(leaf_files, "leaf") if leaf_files else self.items.repartitionByRange("leaf")
        dealt.sortWithinPartitions("leaf", "item_id").write.mode("overwrite").parquet(f"{path}/items")
        self.leaf_sizes.write.mode("overwrite").parquet(f"{path}/counts")

    def append_to(self, path: str, vectors: DataFrame) -> None:
        """Add new vectors to a saved index, and their counts; the tree stays.
        If an attempt breaks off between the two, ``recount`` puts it right."""
        new = settle(self.assign(vectors), "items")
        new.repartitionByRange("leaf").sortWithinPartitions("leaf", "item_id").write.mode("append").parquet(f"{path}/items")
        count_leaves(new).write.mode("append").parquet(f"{path}/counts")

    @staticmethod
    def recount(spark: SparkSession, path: str) -> None:
        """Write the counts of a saved index anew from all its items."""
        count_leaves(spark.read.schema("item_id bigint, leaf bigint").parquet(f"{path}/items")).write.mode("overwrite").parquet(f"{path}/counts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        """A saved index, together with what streams have added to it."""
        r = _read(spark, f"{path}/info", f"{INFO}, representatives string, seed int")
        if r is None:
            raise FileNotFoundError(path)
        r = r.first()
        config = IndexConfig(r.levels, r.target_cluster_items, r.metric, r.representatives or "offset", r.seed or 0)
        read = lambda x: spark.read.parquet(f"{path}/{x}")
        index = VectorIndex(config, r.dim, r.node_size, r.total_clusters, read("reps"), read("nodes"), read("items"), read("counts"), read("paths"))
        streamed = _read(spark, f"{path}/stream", STREAMED)
        return index if streamed is None else index.with_items(streamed)

    def with_items(self, items: DataFrame) -> VectorIndex:
        """The index with items that have their leaves already."""
        items = items.select("item_id", "leaf", "embedding")
        return replace(self, items=self.items.unionByName(items), counts=self.counts.unionByName(count_leaves(items)))

    def describe(self) -> str:
        return json.dumps(asdict(self.config) | {"dim": self.dim, "node_size": self.node_size, "total_clusters": self.total_clusters})


#: What streams have added below a saved index.
STREAMED = "item_id bigint, leaf bigint, embedding array<float>, batch bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The rows at ``path``, or None if there is nothing."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def count_leaves(items: DataFrame) -> DataFrame:
    return items.groupBy("leaf").agg(F.count("*").alias("n"))


def _paths(nodes: DataFrame, levels: int) -> DataFrame:
    paths = nodes.filter(F.col("level") == levels).select(F.col("node").alias("leaf"), F.col("parent").alias("up"), F.col("centroid").alias("centroids"))
    for level in range(levels - 1, 0, -1):
        above = nodes.filter(F.col("level") == level).select(F.col("node").alias("up"), F.col("parent").alias("next"), "centroid")
        paths = paths.join(above, "up").select("leaf", F.col("next").alias("up"), F.concat("centroid", "centroids").alias("centroids"))
    return paths.select("leaf", "centroids")


def build_index(vectors: DataFrame, config: IndexConfig = IndexConfig(), reps: DataFrame | None = None) -> VectorIndex:
    """Choose representatives (or take ``reps``), grow the tree level by level
    by greedy descent, and put every vector into one leaf.

    Level l holds the first ``min(node_size ** l, clusters)`` representatives;
    each has been dropped down the levels above it. The nodes of the finished
    levels are kept (persisted) between steps, so that no step computes those
    before it again; the items with their leaves are settled. Rows that share an
    identifier are an item each.
    """
    dim, items = measure(vectors)
    if reps is None:
        clusters = total_clusters(items, config.target_cluster_items)
        reps = R.select_representatives(vectors, clusters, config.target_cluster_items, config.representatives, config.seed).persist()
    else:
        reps = R.from_table(reps).persist()
    clusters = reps.count()
    fan_out = node_size(clusters, config.levels)
    as_node = lambda level, rows, parent: rows.select(F.lit(level).alias("level"), F.col("rep").alias("node"), parent.cast("bigint").alias("parent"), F.col("embedding").alias("centroid"))
    nodes = as_node(1, reps.filter(F.col("rep") < fan_out), F.lit(None)).persist()
    for level in range(2, config.levels + 1):
        mine = reps.filter(F.col("rep") < level_size(level, fan_out, clusters)).select(F.col("rep").alias("item_id"), "embedding")
        placed = descend(mine, nodes, config.metric, level - 1, carry=True).withColumnsRenamed({"item_id": "rep", "node": "above"})
        nodes = nodes.unionByName(as_node(level, placed, F.col("above"))).persist()
    found = settle(descend(spread(vectors), nodes, config.metric, config.levels, carry=True).select("item_id", F.col("node").alias("leaf"), "embedding"), "items")
    return VectorIndex(config, dim, fan_out, clusters, reps, nodes, found, settle(count_leaves(found), "counts"), settle(_paths(nodes, config.levels), "paths"))
