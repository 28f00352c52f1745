"""The engine's queries for the driver contract, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.metrics import Metric, batch_rows, chunk_rows, level_size, memory_bytes, node_size, total_clusters
from .operators import representatives as R
from .operators import search as S
from .operators import stats
from .operators.assign import group_members, group_offsets, nearest
from .plans.index import IndexConfig, VectorIndex, build_index
from .sources.embeddings import read_embeddings

Query = Callable[[SparkSession, str], DataFrame]

TCS, K = 10, 10
ASKED_EVERY, EXCLUDED, LRU_KEEP = 50, (10, 44, 233, 272), 20
#: Share of the leaves that finds 0.9 of the true neighbours at each table size.
LEAF_PERCENT, SHARES = 80, (10, 25, 50, 80, 100)
_built: dict[tuple, VectorIndex] = {}


# ---- inputs


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_embeddings(spark, f"{sf_dir}/embeddings.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries: every row whose identifier is divisible by ``ASKED_EVERY``."""
    return vectors(spark, sf_dir).filter(F.col("item_id") % ASKED_EVERY == 0).select(F.col("item_id").alias("qid"), F.col("embedding").alias("qv"))


def index(spark: SparkSession, sf_dir: str, levels: int = 2, metric: str = "IP") -> VectorIndex:
    key = (spark.sparkContext.applicationId, sf_dir, levels, metric)
    if key not in _built:
        _built[key] = build_index(vectors(spark, sf_dir), IndexConfig(levels, TCS, metric))
    return _built[key]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


# ---- SQL


def _value(metric: str, a: str, b: str) -> str:
    if metric == "L2":
        return f"list_distance({a}, {b})"
    dot = f"list_inner_product({a}, {b})"
    return dot if metric == "IP" else f"coalesce({dot} / nullif(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 0), 0)"


def _cost(metric: str, a: str, b: str) -> str:
    return _value(metric, a, b) if metric == "L2" else f"(-({_value(metric, a, b)}))"


ASKED = f"vec_id % {ASKED_EVERY} = 0"
V = "v as (select vec_id, embedding::double[] e from embeddings)"


def _params(levels: int) -> str:
    return f"p as (select count(*) n, ceil(count(*) / {TCS}.0)::bigint c, ceil(pow(ceil(count(*) / {TCS}.0), 1.0 / {levels}))::bigint ns from embeddings)"


REPS = f"reps as (select vec_id // {TCS} rep, vec_id, e rv from v where vec_id % {TCS} = 0)"


def _step(name: str, source: str, level: int, metric: str, target: int) -> str:
    """A step of the greedy descent of ``source`` (id, e, cur) into ``level``."""
    inner = f" and n.node in (select parent from n{level + 1})" if level < target else ""
    link = "true" if level == 1 else "n.parent = s.cur"
    return f"{name} as (select s.id, any_value(s.e) e, arg_min(n.node, struct_pack(c := {_cost(metric, 's.e', 'n.cv')}, k := n.node)) cur from {source} s join n{level} n on {link}{inner} group by s.id)"


def tree(levels: int, metric: str) -> list[str]:
    """CTEs: n1..nL (node, parent, cv) and items (vec_id, leaf, e)."""
    out = [V, _params(levels), REPS, "n1 as (select rep node, null::bigint parent, rv cv from reps, p where rep < least(ns, c))"]

    def descend(prefix: str, source: str, target: int) -> str:
        for level in range(1, target + 1):
            out.append(_step(f"{prefix}{level}", source, level, metric, target))
            source = f"{prefix}{level}"
        return source

    for level in range(2, levels + 1):
        out.append(f"r{level}_0 as (select rep id, rv e, 0::bigint cur from reps, p where rep < least(pow(ns, {level})::bigint, c))")
        last = descend(f"r{level}_", f"r{level}_0", level - 1)
        out.append(f"n{level} as (select id node, cur parent, e cv from {last})")
    out.append("i0 as (select vec_id id, e, 0::bigint cur from v)")
    last = descend("i", "i0", levels)
    out.append(f"items as (select id vec_id, cur leaf, e from {last})")
    return out


def _with(parts: list[str], select: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + select


def searching(levels: int, metric: str, exclude: str = "") -> list[str]:
    """CTEs up to ``pool``: qid, leaf_rank, vec_id, dist of all leaves."""
    joins, costs = f"n{levels} n{levels}_", []
    for level in range(levels, 0, -1):
        if level < levels:
            joins += f" join n{level} n{level}_ on n{level + 1}_.parent = n{level}_.node"
        costs.insert(0, _cost(metric, f"n{level}_.cv", "qv"))
    out = tree(levels, metric)
    out.append(f"q as (select vec_id qid, e qv from v where {ASKED})")
    out.append(f"d as (select qid, qv, n{levels}_.node leaf, [{', '.join(costs)}] path from q, {joins} where n{levels}_.node in (select leaf from items))")
    out.append("rk as (select qid, qv, leaf, list_filter(path, lambda x, i: x >= list_max(path[i:])) key, row_number() over (partition by qid order by list_filter(path, lambda x, i: x >= list_max(path[i:])), leaf) leaf_rank from d)")
    out.append(f"pool as (select qid, leaf_rank, vec_id, {_cost(metric, 'e', 'qv')} dist from rk join items using (leaf){exclude})")
    return out


def _found(levels: int, metric: str, exclude: str = "") -> str:
    b = _share(LEAF_PERCENT)
    return _with(searching(levels, metric, exclude), f"select * from (select qid, row_number() over (partition by qid order by dist, vec_id) rank, vec_id item_id, round(dist, 6) + 0.0 dist from pool where leaf_rank <= {b}) where rank <= {K}")


def _share(percent: int | str) -> str:
    return f"(select (count(distinct leaf) * {percent} + 99) // 100 from items)"


def rounds(k: int, b: int, most: int) -> list[str]:
    """CTEs up to ``ranked``: the pool in rounds, as paging shows it."""
    out = searching(2, "IP")
    out.append("cnt as (select qid, leaf_rank, count(vec_id) n from rk left join pool using (qid, leaf_rank) group by all)")
    out.append("cum as (select qid, leaf_rank, sum(n) over (partition by qid order by leaf_rank) cum from cnt)")
    out.append(f"steps as (select range i, {b} * pow(2, range)::bigint budget from range(0, {most + 1 if most >= 0 else 40}))")
    out.append(f"en as (select qid, coalesce(min(leaf_rank) filter (cum >= {k}), max(leaf_rank)) need from cum group by qid)")
    out.append("bu as (select qid, coalesce(min(budget) filter (budget >= need), max(budget)) budget from en, steps group by qid)")
    out.append(f"ranked as (select qid, vec_id, dist, case when leaf_rank <= budget then 0 else ceil((leaf_rank - budget) / {b}.0)::bigint end round, row_number() over (partition by qid order by case when leaf_rank <= budget then 0 else ceil((leaf_rank - budget) / {b}.0)::bigint end, dist, vec_id) rank from pool join bu using (qid))")
    return out


# ---- queries


def _registry() -> tuple[dict[str, Query], dict[str, str]]:
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def add(name: str, query: Query, oracle: str | None = None) -> None:
        found[name] = query
        if oracle:
            sql[name] = oracle

    def wide(ix: VectorIndex, q: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
        return rounded(S.search(ix, q, K, S.leaf_budget(ix, LEAF_PERCENT), exclude, 0), "dist")

    for m in ("IP", "L2", "COS"):
        low = m.lower()
        add(
            f"{low}_scores",
            lambda s, d, m=m: rounded(S.all_scores(vectors(s, d), asked(s, d), m), "value"),
            _with([V], f"select q.vec_id qid, v.vec_id item_id, round({_value(m, 'v.e', 'q.e')}, 6) + 0.0 as value from v, v q where q.{ASKED}"),
        )
        add(
            f"topk_{low}",
            lambda s, d, m=m: rounded(S.brute_force(vectors(s, d), asked(s, d), K, m), "dist"),
            _with([V], f"select qid, rank, item_id, round(dist, 6) + 0.0 dist from (select q.vec_id qid, v.vec_id item_id, {_cost(m, 'v.e', 'q.e')} dist, row_number() over (partition by q.vec_id order by {_cost(m, 'v.e', 'q.e')}, v.vec_id) rank from v, v q where q.{ASKED}) where rank <= {K}"),
        )
        add(
            f"assign_{low}",
            lambda s, d, m=m: nearest(vectors(s, d), R.offset(vectors(s, d), TCS).select(F.col("rep").alias("node"), F.col("embedding").alias("centroid")), m),
            _with([V, REPS], f"select v.vec_id item_id, arg_min(rep, struct_pack(c := {_cost(m, 'v.e', 'rv')}, k := rep)) node from v, reps group by 1"),
        )
        add(f"search_{low}", lambda s, d, m=m: wide(index(s, d, 2, m), asked(s, d)), _found(2, m))
        add(
            f"node_border_{low}",
            lambda s, d, m=m: rounded(stats.borders(index(s, d, 2, m)), "border_cost"),
            _with(tree(2, m), f"select leaf, arg_max(vec_id, struct_pack(c := {_cost(m, 'e', 'cv')}, k := -vec_id)) border_item, round(max({_cost(m, 'e', 'cv')}), 6) + 0.0 border_cost, count(*) n_items from items join n2 on node = leaf group by leaf"),
        )

    def info(s: SparkSession, d: str) -> DataFrame:
        return index(s, d, 3).info

    add("index_info", info, _with([_params(3)], f"select 3::int levels, 'IP' metric, 1::int metric_code, ns node_size, c total_clusters, {TCS}::bigint target_cluster_items, (select len(embedding) from embeddings limit 1)::int dim from p"))
    add("level_sizes", lambda s, d: index(s, d, 3).level_sizes(), _with([_params(3)], "select l::int \"level\", least(pow(ns, l)::bigint, c) nodes from p, (values (1), (2), (3)) t(l)"))

    def chunk_plan(s: SparkSession, d: str) -> DataFrame:
        rows = [(dim, size, chunk_rows(dim, size), batch_rows(4, dim, size)) for dim in (64, 512, 768, 1024) for size in (2, 4, 8)]
        return s.createDataFrame(rows, "dim int, item_bytes int, chunk_rows bigint, batch_rows bigint")

    add("chunk_plan", chunk_plan, "select dim::int dim, b::int item_bytes, (52428800 // (dim * b))::bigint chunk_rows, (2147483648 // (dim * b))::bigint batch_rows from (values (64), (512), (768), (1024)) t(dim), (values (2), (4), (8)) u(b)")

    def memory_plan(s: SparkSession, d: str) -> DataFrame:
        n = vectors(s, d).count()
        c = total_clusters(n, TCS)
        rows = [(levels, node_size(c, levels), level_size(levels, node_size(c, levels), c), memory_bytes(n, c, 64, 4)) for levels in (1, 2, 3)]
        return s.createDataFrame(rows, "levels int, node_size bigint, leaves bigint, bytes bigint")

    one = f"(select count(*) n, ceil(count(*) / {TCS}.0)::bigint c from embeddings)"
    add("memory_plan", memory_plan, f"select l::int levels, ceil(pow(c, 1.0 / l))::bigint node_size, least(pow(ceil(pow(c, 1.0 / l)), l)::bigint, c) leaves, (4 * (n * 64 + c * 64 + n * c))::bigint bytes from {one}, (values (1), (2), (3)) t(l)")

    # representatives; vectors appear as sums, to compare them without arrays
    flat = lambda reps: reps.select("rep", "item_id", (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5) + F.lit(0.0)).alias("total"))
    add("reps_offset", lambda s, d: flat(R.offset(vectors(s, d), TCS)), _with([V, REPS], "select rep, vec_id item_id, round(list_sum(rv), 5) + 0.0 total from reps"))
    seeded = f"select row_number() over (order by md5(vec_id::varchar || ':7'), vec_id) - 1 rep, vec_id item_id, e from v qualify rep < (select ceil(count(*) / {TCS}.0) from v)"
    add("reps_random_seeded", lambda s, d: flat(R.random(vectors(s, d), total_clusters(vectors(s, d).count(), TCS), 7)), _with([V], f"select rep, item_id, round(list_sum(e), 5) + 0.0 total from ({seeded})"))
    add("reps_from_table", lambda s, d: flat(R.from_table(vectors(s, d))), _with([V], "select row_number() over (order by vec_id) - 1 rep, vec_id item_id, round(list_sum(e), 5) + 0.0 total from v"))

    def lloyd(s: SparkSession, d: str) -> DataFrame:
        v = vectors(s, d)
        reps = R.offset(v, TCS).select(F.col("rep").alias("node"), F.col("embedding").alias("centroid"))
        return R.lloyd_step(v, nearest(v, reps, "L2")).select("rep", F.posexplode("embedding").alias("pos", "x")).select("rep", F.col("pos").cast("bigint").alias("pos"), (F.round(F.col("x").cast("double"), 4) + F.lit(0.0)).alias("x"))

    lloyd_sql = _with(
        [V, REPS, f"a as (select v.vec_id, any_value(v.e) e, arg_min(rep, struct_pack(c := {_cost('L2', 'v.e', 'rv')}, k := rep)) rep from v, reps group by 1)", "x as (select rep, unnest(e) x, generate_subscripts(e, 1) - 1 pos from a)"],
        "select rep, pos::bigint pos, round(avg(x)::float::double, 4) + 0.0 x from x group by rep, pos",
    )
    add("reps_lloyd_step", lloyd, lloyd_sql)

    def kmeans(s: SparkSession, d: str) -> DataFrame:
        v = vectors(s, d)
        return R.kmeans(v, total_clusters(v.count(), TCS), 1).select("rep", F.posexplode("embedding").alias("pos", "x")).select("rep", F.col("pos").cast("bigint").alias("pos"), (F.round(F.col("x").cast("double"), 4) + F.lit(0.0)).alias("x"))

    # the table is one mini-batch here: a step from the seeded start
    kmeans_sql = _with(
        [
            V,
            f"st as (select row_number() over (order by md5(vec_id::varchar || ':1'), vec_id) - 1 rep, e rv from v qualify rep < (select ceil(count(*) / {TCS}.0) from v))",
            f"a as (select v.vec_id, any_value(v.e) e, arg_min(rep, struct_pack(c := {_cost('L2', 'v.e', 'rv')}, k := rep)) rep from v, st group by 1)",
            "x as (select rep, unnest(e) x, generate_subscripts(e, 1) - 1 pos from a)",
            "m as (select rep, pos, avg(x) x from x group by all)",
            "b as (select rep, unnest(rv) x, generate_subscripts(rv, 1) - 1 pos from st)",
        ],
        "select b.rep, b.pos::bigint pos, round(coalesce(m.x, b.x)::float::double, 4) + 0.0 x from b left join m using (rep, pos)",
    )
    add("reps_kmeans", kmeans, kmeans_sql)
    add(
        "ordinal_ids",
        lambda s, d: read_embeddings(s, f"{d}/embeddings.parquet", order_by=["label", "vec_id"]).select("item_id", (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5) + F.lit(0.0)).alias("total")),
        "select row_number() over (order by label, vec_id) - 1 item_id, round(list_sum(embedding::double[]), 5) + 0.0 total from embeddings",
    )

    # grouping
    assigned = lambda s, d: nearest(vectors(s, d), R.offset(vectors(s, d), TCS).select(F.col("rep").alias("node"), F.col("embedding").alias("centroid")), "IP")
    own = f"a as (select v.vec_id item_id, arg_min(rep, struct_pack(c := {_cost('IP', 'v.e', 'rv')}, k := rep)) node from v, reps group by 1)"
    add("csr_offsets", lambda s, d: group_offsets(assigned(s, d), total_clusters(vectors(s, d).count(), TCS)), _with([V, REPS, own], "select node, n, (sum(n) over (order by node) - n)::bigint first from (select rep node, count(item_id) n from reps left join a on node = rep group by rep)"))
    add("csr_members", lambda s, d: group_members(assigned(s, d)), _with([V, REPS, own], "select node, row_number() over (partition by node order by item_id) - 1 place, item_id from a"))

    # trees
    for levels in (2, 3):
        nodes = " union all ".join(f"select {n}::int \"level\", node, coalesce(parent, -1) parent from n{n}" for n in range(1, levels + 1))
        add(f"rep_tree_l{levels}levels", lambda s, d, n=levels: index(s, d, n).nodes.select("level", "node", F.coalesce("parent", F.lit(-1)).cast("bigint").alias("parent")), _with(tree(levels, "IP"), nodes))
    for levels in (1, 2, 3):
        add(f"leaf_assign_{levels}levels", lambda s, d, n=levels: index(s, d, n).items.select("item_id", "leaf"), _with(tree(levels, "IP"), "select vec_id item_id, leaf from items"))
    add("leaf_occupancy", lambda s, d: stats.occupancy(index(s, d)), _with(tree(2, "IP"), "select node leaf, count(vec_id) n_items from n2 left join items on leaf = node group by node"))

    # searches
    add("leaf_visit_order", lambda s, d: S.visit_order(index(s, d), asked(s, d)).select("qid", "leaf", "leaf_rank"), _with(searching(2, "IP"), "select qid, leaf, leaf_rank from rk"))
    for levels in (1, 3):
        add(f"search_{levels}level" + "s" * (levels > 1), lambda s, d, n=levels: wide(index(s, d, n), asked(s, d)), _found(levels, "IP"))
    gone = f" where vec_id not in {EXCLUDED}"
    drop = lambda s: s.createDataFrame([(x,) for x in EXCLUDED], "item_id bigint")
    add("search_exclude", lambda s, d: wide(index(s, d), asked(s, d), drop(s)), _found(2, "IP", gone))
    page = lambda parts, lo, hi: _with(parts, f"select qid, rank, vec_id item_id, round(dist, 6) + 0.0 dist from ranked where rank > {lo} and rank <= {hi}")
    first = lambda parts, k: _with(parts, f"select qid, rank, vec_id item_id, round(dist, 6) + 0.0 dist from ranked where round = 0 and rank <= {k}")
    add("search_expand", lambda s, d: rounded(S.search(index(s, d), asked(s, d), 60, 1), "dist"), first(rounds(60, 1, -1), 60))
    add("search_capped", lambda s, d: rounded(S.search(index(s, d), asked(s, d), 60, 1, max_increments=1), "dist"), first(rounds(60, 1, 1), 60))
    add("search_page2", lambda s, d: rounded(S.open_session(index(s, d), asked(s, d), K, 2).page(1), "dist"), page(rounds(K, 2, -1), K, 2 * K))
    add("search_pages_concat", lambda s, d: rounded(S.open_session(index(s, d), asked(s, d), K, 2).pool, "dist"), page(rounds(K, 2, -1), 0, 10**9))
    def recall_by_budget(s: SparkSession, d: str) -> DataFrame:
        q = asked(s, d).persist()
        exact = S.brute_force(vectors(s, d), q, K, "IP").persist()
        out = None
        for b in (1, 4, 16, 64):
            one = S.recall(S.search(index(s, d), q, K, b, max_increments=0), exact).agg(F.round(F.avg("recall"), 6).alias("mean_recall")).select(F.lit(b).alias("search_exp"), "mean_recall")
            out = one if out is None else out.union(one)
        return out

    recall_sql = _with(
        [
            *searching(2, "IP"),
            f"ex as (select qid, vec_id from (select qid, v.vec_id, row_number() over (partition by qid order by {_cost('IP', 'v.e', 'qv')}, v.vec_id) r from v, q) where r <= {K})",
            f"fo as (select b, qid, vec_id from (select b, qid, vec_id, row_number() over (partition by b, qid order by dist, vec_id) r from pool, (values (1), (4), (16), (64)) t(b) where leaf_rank <= b) where r <= {K})",
            f"rc as (select b, ex.qid, count(fo.vec_id) / {K}.0 recall from (values (1), (4), (16), (64)) t(b) cross join ex left join fo using (b, qid, vec_id) group by all)",
        ],
        "select b::int search_exp, round(avg(recall::double), 6) mean_recall from rc group by b",
    )
    add("recall_at_k_by_budget", recall_by_budget, recall_sql)

    def recall_by_share(s: SparkSession, d: str) -> DataFrame:
        q, ix, out = asked(s, d).persist(), index(s, d), None
        exact = S.brute_force(vectors(s, d), q, K, "IP").persist()
        for p in SHARES:
            one = S.recall(S.search(ix, q, K, S.leaf_budget(ix, p), max_increments=0), exact).agg(F.round(F.avg("recall"), 6).alias("mean_recall")).select(F.lit(p).alias("leaf_percent"), "mean_recall")
            out = one if out is None else out.union(one)
        return out

    shares = f"(values {', '.join(f'({p})' for p in SHARES)}) t(p)"
    share_sql = _with(
        [
            *searching(2, "IP"),
            f"ex as (select qid, vec_id from (select qid, v.vec_id, row_number() over (partition by qid order by {_cost('IP', 'v.e', 'qv')}, v.vec_id) r from v, q) where r <= {K})",
            "bs as (select p, (n * p + 99) // 100 b from (select count(distinct leaf) n from items), " + shares + ")",
            f"fo as (select p, qid, vec_id from (select p, qid, vec_id, row_number() over (partition by p, qid order by dist, vec_id) r from pool, bs where leaf_rank <= b) where r <= {K})",
            f"rc as (select p, ex.qid, count(fo.vec_id) / {K}.0 recall from {shares} cross join ex left join fo using (p, qid, vec_id) group by all)",
        ],
        "select p::int leaf_percent, round(avg(recall::double), 6) mean_recall from rc group by p",
    )
    add("recall_at_k_by_share", recall_by_share, share_sql)

    def appended(s: SparkSession, d: str) -> DataFrame:
        from dataclasses import replace

        whole, v = index(s, d), vectors(s, d)
        grown = replace(whole, items=whole.items.limit(0), counts=whole.counts.limit(0)).append(v.filter("item_id % 2 = 0")).append(v.filter("item_id % 2 = 1"))
        return grown.items.select("item_id", "leaf")

    add("append_batches", appended, _with(tree(2, "IP"), "select vec_id item_id, leaf from items"))

    def repeated(s: SparkSession, d: str) -> DataFrame:
        return index(s, d).append(vectors(s, d).withColumn("item_id", F.expr("item_id div 2"))).items.select("item_id", "leaf")

    add("append_repeated_ids", repeated, _with(tree(2, "IP"), "select vec_id item_id, leaf from items union all select vec_id // 2, leaf from items"))
    held = " union all ".join(f"select {n}::int \"level\", node, {str(n <= 2).lower()} loaded from n{n}" for n in (1, 2, 3))
    add("cache_state", lambda s, d: stats.NodeCache(index(s, d, 3), prefetch=2).wait().state(), _with(tree(3, "IP"), held))

    def evict(s: SparkSession, d: str) -> DataFrame:
        events = s.read.parquet(f"{d}/events.parquet")
        return stats.eviction_plan(events, LRU_KEEP, "user_id", "event_id")

    add("lru_eviction_plan", evict, f"select user_id node, last_access from (select user_id, max(event_id) last_access, row_number() over (order by max(event_id) desc, user_id desc) r from events group by user_id) where r > {LRU_KEEP}")
    return found, sql


def queries() -> dict[str, Query]:
    return _registry()[0]


def oracle_sql() -> dict[str, str]:
    return _registry()[1]
