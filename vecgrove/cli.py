"""``python -m vecgrove.cli build|search``: the engine from the command line."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.metrics import Metric
from .operators.representatives import OPTIONS
from .operators.search import search
from .plans.index import IndexConfig, VectorIndex, build_index
from .sources.embeddings import KINDS, read_embeddings, read_representatives

log = logging.getLogger("vecgrove")


def enable_logging(sink=sys.stderr, level: int | str = logging.INFO) -> None:
    """Send the engine's log to a stream or file."""
    handler = logging.StreamHandler(sink) if hasattr(sink, "write") else logging.FileHandler(sink)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(level)


def timed(what: str):
    """Log how long a block takes."""
    from contextlib import contextmanager

    @contextmanager
    def timer():
        began = time.time()
        yield
        log.info("%s took %.2f s", what, time.time() - began)

    return timer()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vecgrove")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="build an index from a file of embeddings")
    b.add_argument("embeddings_file")
    b.add_argument("--save-file", default="index.vecgrove")
    b.add_argument("--levels", type=int, default=3)
    b.add_argument("--target-cluster-items", type=int, default=100)
    b.add_argument("--metric", default="L2", help="L2, IP or COS, in any case")
    b.add_argument("--workers", type=int, default=4, help="local threads, where no Spark master is given")
    b.add_argument("--memory-limit", type=int, default=4, help="GB for the driver, where no Spark master is given")
    b.add_argument("--emb-grp-name", default="embeddings")
    b.add_argument("--rep-selection", default="offset", help=", ".join(OPTIONS))
    b.add_argument("--file-store", choices=sorted(KINDS), help="kind of the embeddings file, where its suffix doesn't tell")
    b.add_argument("--rep-file", help="representatives chosen before")
    b.add_argument("--rep-emb-grp", default="rep_embeddings", help="their vectors: a column or an array")
    b.add_argument("--rep-ids-grp", default="rep_item_ids", help="their identifiers: a column or an array")
    b.add_argument("--rep-file-store", choices=sorted(KINDS), help="kind of that file, where its suffix doesn't tell")
    b.add_argument("--seed", type=int, default=0)
    s = sub.add_parser("search", help="search a saved index")
    s.add_argument("index")
    s.add_argument("queries", help="Parquet with item_id (the query's number) and embedding")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--search-exp", type=int, default=64)
    s.add_argument("--max-increments", type=int, default=-1)
    s.add_argument("--output", help="write Parquet here instead of printing")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    enable_logging()
    session = SparkSession.builder.appName("vecgrove")
    if args.command == "build" and SparkSession.getActiveSession() is None and "SPARK_MASTER" not in os.environ:
        workers = args.workers if args.workers <= (os.cpu_count() or 1) else max(1, (os.cpu_count() or 2) - 1)
        session = session.master(f"local[{workers}]").config("spark.driver.memory", f"{args.memory_limit}g")
    spark = session.getOrCreate()
    if args.command == "build":
        try:
            config = IndexConfig(args.levels, args.target_cluster_items, Metric.parse(args.metric).name, args.rep_selection, args.seed)
            vectors = read_embeddings(spark, args.embeddings_file, args.emb_grp_name, kind=args.file_store)
            reps = read_representatives(spark, args.rep_file, args.rep_emb_grp, args.rep_ids_grp, args.rep_file_store) if args.rep_file else None
        except Exception as e:
            log.error("%s", e)
            return 1
        with timed("build"):
            index = build_index(vectors, config, reps)
            index.save(args.save_file)
        log.info("%s", index.describe())
        return 0
    index = VectorIndex.load(spark, args.index)
    queries = read_embeddings(spark, args.queries).select(F.col("item_id").alias("qid"), F.col("embedding").alias("qv"))
    with timed("search"):
        found = search(index, queries, args.k, args.search_exp, max_increments=args.max_increments)
        if args.output:
            found.write.mode("overwrite").parquet(args.output)
        else:
            for r in found.orderBy("qid", "rank").toLocalIterator():
                print(r.qid, r.rank, r.item_id, f"{r.dist:.6f}", sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
