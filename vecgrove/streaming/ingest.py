"""Growing a saved index from a stream of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import STREAMED, VectorIndex


def ingest(stream: DataFrame, index: VectorIndex, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Add each micro-batch (``item_id, embedding``) to the index at ``path``.

    The tree stays as it is. Every batch goes to a folder of its own number, so
    a batch that is run again overwrites itself: each vector is added once.
    """

    def add(batch: DataFrame, number: int) -> None:
        vectors = batch.select(F.col("item_id").cast("bigint"), F.col("embedding").cast("array<float>").alias("embedding"))
        index.assign(vectors).sortWithinPartitions("leaf", "item_id").write.mode("overwrite").parquet(f"{path}/stream/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_stream(index: VectorIndex, path: str) -> VectorIndex:
    """The index together with what streams have added to it at ``path``; a
    loaded index has it already."""
    return index.with_items(index.items.sparkSession.read.schema(STREAMED).parquet(f"{path}/stream"))
