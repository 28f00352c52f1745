"""Places and running totals in a global order, without a single-task window.

A range sort deals the rows; each range numbers its own rows; what lies before
each range, one value a range, comes back as a small broadcast table. The sorted
rows are settled first, since ranges are drawn anew each time a plan runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before (itself not included)."""
    return _running(df, order, F.col(value), name)


def with_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the place (from 0) of each row; ``order`` should leave no ties."""
    return _running(df, order, F.lit(1), name)


def _running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    so_far = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = df.withColumn("_value", value.cast("bigint")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    local = settle(dealt.withColumn(name, F.sum("_value").over(so_far) - F.col("_value")), "ordered")
    total, before = 0, []
    for r in sorted(local.groupBy("_range").agg(F.sum("_value").alias("n")).collect()):
        before.append((r["_range"], total))
        total += r.n
    values = ", ".join(f"({k}, {n}L)" for k, n in before) or "(0, 0L)"
    offsets = df.sparkSession.sql(f"select * from values {values} as t(_range, _before)")  # needs no Python worker
    return local.join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before", "_value")
