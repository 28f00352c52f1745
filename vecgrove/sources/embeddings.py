"""Reading dense vectors: one row a vector, ``item_id`` and ``embedding``."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Kinds of stores by name, beside the suffixes of paths.
KINDS = {"parquet": ".parquet", "h5": ".h5", "zarr_l": ".zarr", "zarr_z": ".zip"}


def read_embeddings(spark: SparkSession, path: str, name: str = "embeddings", id_col: str | None = None, vector_col: str = "embedding", order_by: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """Vectors from Parquet, HDF5 (``.h5``) or zarr (``.zarr``, ``.zip``,
    ``.zipstore``); ``kind`` (of ``KINDS``) goes before the path's suffix. Array
    formats have no keys: the row number is the id. So it is for Parquet without
    an identifier, in the order of the columns ``order_by``, or else of files
    and rows."""
    suffix = KINDS[kind] if kind else PurePosixPath(path).suffix.lower()
    if suffix in (".parquet", ""):
        df = spark.read.parquet(path)
        if vector_col not in df.columns:
            raise ValueError(f"{path} has no column {vector_col!r}")
        if id_col is None and order_by is None:
            id_col = next((c for c in ("item_id", "vec_id", "id") if c in df.columns), None)
        if id_col is None:
            return _numbered(df, vector_col, order_by)
        return df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    if suffix in (".h5", ".zarr", ".zip", ".zipstore"):
        return _read_array(spark, path, name, suffix)
    raise ValueError(f"unknown kind of embeddings file: {path}")


def _numbered(df: DataFrame, vector_col: str, order_by: list[str] | None) -> DataFrame:
    from ..operators.ordering import with_position

    place = [F.col("_metadata.file_path").alias("_1"), F.col("_metadata.row_index").alias("_2")]
    keys = place if order_by is None else [F.col(c).alias(f"_{k}") for k, c in enumerate([*order_by], 3)] + place
    rows = df.select(F.col(vector_col).cast("array<float>").alias("embedding"), *keys)
    return with_position(rows, [c for c in rows.columns if c != "embedding"], "item_id").select("item_id", "embedding")


def read_representatives(spark: SparkSession, path: str, vectors: str = "rep_embeddings", ids: str = "rep_item_ids", kind: str | None = None) -> DataFrame:
    """``item_id, embedding`` of representatives chosen before, in their order
    (``rep``): Parquet with these columns, or an array store with these sets."""
    suffix = KINDS[kind] if kind else PurePosixPath(path).suffix.lower()
    if suffix in (".parquet", ""):
        df = spark.read.parquet(path)
        names = (ids, vectors) if {ids, vectors} <= set(df.columns) else ("item_id", "embedding")
        rep = [F.col("rep")] if "rep" in df.columns else []
        return df.select(*rep, F.col(names[0]).cast("bigint").alias("item_id"), F.col(names[1]).cast("array<float>").alias("embedding"))
    numbers = _shape(path, ids, suffix)[:].tolist()  # as many as clusters
    named = spark.createDataFrame(list(enumerate(map(int, numbers))), "rep bigint, number bigint")
    return _read_array(spark, path, vectors, suffix).withColumnRenamed("item_id", "rep").join(named, "rep").select("rep", F.col("number").alias("item_id"), "embedding")


def _shape(path: str, name: str, suffix: str):
    if suffix == ".h5":
        try:
            import h5py
        except ImportError:
            raise ImportError("reading .h5 needs h5py") from None
        found = h5py.File(path, "r")[name]
    else:
        try:
            import zarr
        except ImportError:
            raise ImportError("reading zarr stores needs zarr") from None
        found = zarr.open(path, mode="r")[name]
    if not hasattr(found, "shape"):
        raise ValueError(f"{name!r} in {path} is a group, not an array")
    return found


def _read_array(spark: SparkSession, path: str, name: str, suffix: str) -> DataFrame:
    """Row ranges of the array are read by the tasks, not by the driver."""
    from ..functions.metrics import chunk_rows

    rows, dim = _shape(path, name, suffix).shape
    step = chunk_rows(dim, 4)

    def read(batches):
        import pandas as pd

        array = _shape(path, name, suffix)
        for batch in batches:
            for a in batch["id"]:
                block = array[a : min(a + step, rows)].astype("float32")
                yield pd.DataFrame({"item_id": range(a, a + len(block)), "embedding": list(block)})

    return spark.range(0, rows, step, max(1, -(-rows // step))).mapInPandas(read, "item_id bigint, embedding array<float>")


def validate(vectors: DataFrame) -> int:
    """The dimension; ``ValueError`` for null or NaN elements, null identifiers
    or mixed dimensions. An empty table has dimension 0."""
    return measure(vectors)[0]


def measure(vectors: DataFrame) -> tuple[int, int]:
    """(dimension, rows) of valid vectors, in one pass; see ``validate``."""
    bad = F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    r = vectors.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), F.count_if(F.col("item_id").isNull()).alias("no_id")).first()
    if not r.n:
        return 0, 0
    if r.bad or r.no_id:
        raise ValueError(f"{r.bad} vectors hold nulls or NaN, {r.no_id} have no identifier")
    if r.lo != r.hi:
        raise ValueError(f"mixed dimensions: {r.lo} to {r.hi}")
    return r.lo, r.n
