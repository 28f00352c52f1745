"""Choosing cluster representatives: ``rep, item_id, embedding``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .ordering import with_position

OPTIONS = ("offset", "random", "mbk", "dissimilar")


def select_representatives(vectors: DataFrame, clusters: int, every: int, option: str = "offset", seed: int = 0) -> DataFrame:
    if option == "offset":
        return offset(vectors, every)
    if option == "random":
        return random(vectors, clusters, seed)
    if option == "mbk":
        return kmeans(vectors, clusters, seed)
    if option == "dissimilar":
        raise NotImplementedError("representatives by dissimilarity are not available")
    raise ValueError(f"unknown option {option!r}; one of {', '.join(OPTIONS)}")


#: Rows of one mini-batch.
SLICE_ROWS = 200_000


def are_ordinals(vectors: DataFrame) -> bool:
    """Whether the identifiers are 0, 1, ... each once: as many, and with the
    same sum of hashes, in one pass."""
    key = F.xxhash64("id").cast("decimal(38,0)")
    mine = vectors.select(F.col("item_id").alias("id")).agg(F.count("*"), F.sum(key)).first()
    return tuple(mine) == tuple(vectors.sparkSession.range(mine[0]).agg(F.count("*"), F.sum(key)).first())


def offset(vectors: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th item in the order of identifiers, from the first. Where
    they run 0, 1, ... no sort is needed; with gaps or repeats, places in a sort
    of identifiers (and a hash of the vector) count."""
    if are_ordinals(vectors):
        return vectors.filter(F.col("item_id") % every == 0).select((F.col("item_id") / every).cast("bigint").alias("rep"), "item_id", "embedding")
    keyed = vectors.withColumn("key", F.xxhash64("embedding"))
    placed = with_position(keyed.select("item_id", "key"), ["item_id", "key"], "place").filter(F.col("place") % every == 0)
    chosen = placed.select("item_id", "key", (F.col("place") / every).cast("bigint").alias("rep"))
    return keyed.join(chosen, ["item_id", "key"]).dropDuplicates(["rep"]).select("rep", "item_id", "embedding")


def random(vectors: DataFrame, clusters: int, seed: int = 0) -> DataFrame:
    """``clusters`` items without replacement, in an order that only the seed
    decides. The sort works on keys and identifiers; only the chosen rows meet
    their vectors again."""
    key = F.md5(F.concat(F.col("item_id").cast("string"), F.lit(f":{seed}")))
    placed = with_position(vectors.select("item_id", key.alias("key")), ["key", "item_id"], "rep")
    return vectors.join(placed.filter(F.col("rep") < clusters), "item_id").select("rep", "item_id", "embedding")


def lloyd_step(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """One k-means step: the mean of each representative's items (``item_id,
    node`` in ``assigned``); a representative without items disappears."""
    parts = vectors.join(assigned, "item_id").select("node", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("node", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("e"))
    return listed.select(F.col("node").alias("rep"), F.col("node").alias("item_id"), F.transform("e", lambda p: p["x"].cast("float")).alias("embedding"))


def kmeans(vectors: DataFrame, clusters: int, seed: int = 0, slice_rows: int | None = None) -> DataFrame:
    """Centres of mini-batch k-means with made-up identifiers 0, 1, ...

    The start is ``random``'s choice. Each vector is in one slice of about
    ``slice_rows`` rows; slice by slice, vectors go to their nearest centre and
    centres become the mean of all vectors they have had so far (the start
    doesn't count). A centre that has had none stays. Centres are a table, never
    on the driver.
    """
    from .assign import descend, one_level

    slices = max(1, -(-vectors.count() // (slice_rows or SLICE_ROWS)))
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    centres = settle(random(vectors, clusters, seed).select("rep", doubles.alias("centre"), F.lit(0).cast("bigint").alias("seen")), "centres")
    for k in range(slices):
        part = vectors if slices == 1 else vectors.filter(F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(slices)) == k)
        nodes = one_level(centres.select(F.col("rep").alias("node"), F.col("centre").cast("array<float>").alias("centroid")))
        parts = descend(part, nodes, "L2", 1, carry=True).select("node", F.posexplode("embedding").alias("pos", "x"))
        sums = parts.groupBy("node", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
        sums = sums.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("sums"), F.first("n").alias("n"))
        met = centres.join(sums.withColumnRenamed("node", "rep"), "rep", "left")
        moved = F.zip_with("centre", "sums", lambda c, s: (c * F.col("seen") + s["x"]) / (F.col("seen") + F.col("n")))
        centres = settle(met.select("rep", F.when(F.col("n").isNull(), F.col("centre")).otherwise(moved).alias("centre"), (F.col("seen") + F.coalesce("n", F.lit(0))).alias("seen")), "centres")
    return centres.select("rep", F.col("rep").alias("item_id"), F.col("centre").cast("array<float>").alias("embedding"))


def from_table(reps: DataFrame, id_col: str = "item_id", vector_col: str = "embedding") -> DataFrame:
    """Chosen elsewhere: the order is that of ``rep``, or else of the identifier."""
    order = "rep" if "rep" in reps.columns else id_col
    named = reps.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(vector_col).cast("array<float>").alias("embedding"), F.col(order).alias("_order"))
    return with_position(named, ["_order", "item_id"], "rep").select("rep", "item_id", "embedding")
