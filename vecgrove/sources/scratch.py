"""The folder that driver and executors share, for results between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is not set and the
    session runs on this machine alone (tests), a temporary folder, made once
    for the application. On a cluster a folder must be set."""
    where = spark.conf.get("spark.checkpoint.dir", "") or ""
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = "file://" + tempfile.mkdtemp(prefix="vecgrove-")
    return _made[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path (a URI) in the application's part of the shared
    folder, which goes when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    top = f"{shared_dir(spark)}/vecgrove-{app}"
    if _made.get(top) != app:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _made[top] = app
    return f"{top}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so
    that a lost executor costs a re-read and not a recomputation."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
