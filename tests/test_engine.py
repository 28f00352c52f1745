"""The index and searches: hand-computed fixtures, an independent best-first
walk, and properties."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecgrove.cli import main
from vecgrove.functions import metrics as M
from vecgrove.operators import representatives as R
from vecgrove.operators import search as S
from vecgrove.operators import stats
from vecgrove.operators.assign import descend, group_members, group_offsets, nearest
from vecgrove.plans.index import IndexConfig, VectorIndex, build_index
from vecgrove.sources.embeddings import read_embeddings, validate

M8 = [(1, 0), (0, 1), (0.8, 0.6), (0.6, 0.8), (-1, 0), (0, -1), (0.6, -0.8), (-0.6, 0.8)]
SCHEMA = "item_id bigint, embedding array<float>"


def frame(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], SCHEMA)


def query(spark, *vectors):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "qid bigint, qv array<float>")


def ids(df):
    return [r.item_id for r in df.orderBy("qid", "rank").collect()]


@pytest.fixture(scope="module")
def m8(spark):
    return frame(spark, M8).persist()


@pytest.fixture(scope="module")
def m8_index(spark, m8):
    return build_index(m8, IndexConfig(2, 2, "IP"))


# ---- metrics


def test_scores(spark, m8):
    q = query(spark, (1, 0))
    for metric, want in (("IP", [1, 0, 0.8, 0.6, -1, 0, 0.6, -0.6]), ("L2", [0, 1.414214, 0.632456, 0.894427, 2, 1.414214, 0.894427, 1.788854])):
        got = [r.value for r in S.all_scores(m8, q, metric).orderBy("item_id").collect()]
        assert np.allclose(got, want, atol=1e-6)
        data = np.array(M8)
        kernel = M.cost_matrix(M.Metric.parse(metric), data, np.array([[1.0, 0.0]]))[:, 0]
        assert np.allclose(kernel if metric == "L2" else -kernel, want, atol=1e-6)


def test_cosine_of_nothing_is_zero(spark):
    got = S.all_scores(frame(spark, [(0, 0), (3, 4)]), query(spark, (1, 0)), "cos").orderBy("item_id").collect()
    assert [r.value for r in got] == [0.0, pytest.approx(0.6)]
    assert M.cost_matrix(M.Metric.COS, np.zeros((1, 2)), np.ones((1, 2)))[0, 0] == 0


def test_metric_names():
    assert M.Metric.parse("cos") is M.Metric.COS and [m.value for m in (M.Metric.L2, M.Metric.IP, M.Metric.COS)] == [0, 1, 2]
    with pytest.raises(ValueError):
        M.Metric.parse("manhattan")


def test_sizes():
    assert M.chunk_rows(64, 4) == 204800
    with pytest.raises(ValueError):
        M.chunk_rows(10**9, 4)
    assert M.total_clusters(500, 10) == 50 and [M.node_size(50, n) for n in (1, 2, 3)] == [50, 8, 4]
    assert M.node_size(3125, 5) == 6  # the floating-point root
    assert M.memory_bytes(10, 2, 3, 4) == 4 * (30 + 6 + 20)


# ---- representatives and assignment


def test_representatives(spark, m8):
    assert [(r.rep, r.item_id) for r in R.offset(m8, 2).orderBy("rep").collect()] == [(0, 0), (1, 2), (2, 4), (3, 6)]
    a, b = ([(r.rep, r.item_id) for r in R.random(m8, 4, s).orderBy("rep").collect()] for s in (1, 1))
    assert a == b and len({i for _, i in a}) == 4 and [r for r, _ in a] == [0, 1, 2, 3]
    assert R.kmeans(m8, 3, 1).count() == 3
    assert [r.item_id for r in R.from_table(m8.filter("item_id > 5")).orderBy("rep").collect()] == [6, 7]
    with pytest.raises(NotImplementedError):
        R.select_representatives(m8, 4, 2, "dissimilar")
    with pytest.raises(ValueError):
        R.select_representatives(m8, 4, 2, "nearest")


def test_ties_go_to_the_lower_node(spark, m8):
    nodes = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "node bigint, centroid array<float>")
    for metric in ("IP", "L2", "COS"):
        got = {r.item_id: r.node for r in nearest(m8, nodes, metric).collect()}
        assert got[0] == 1 and 3 not in got.values()


def test_groups(spark):
    assigned = spark.createDataFrame(list(enumerate([2, 0, 2, 1, 2])), "item_id bigint, node bigint")
    assert [(r.n, r.first) for r in group_offsets(assigned, 4).orderBy("node").collect()] == [(1, 0), (1, 1), (3, 2), (0, 5)]
    assert [r.item_id for r in group_members(assigned).orderBy("node", "place").collect()] == [1, 3, 0, 2, 4]


# ---- the tree


def test_tree(m8_index):
    nodes = m8_index.nodes.collect()
    assert {r.node: r.parent for r in nodes if r.level == 2} == {0: 0, 1: 1, 2: 1, 3: 0}
    assert {r.item_id: r.leaf for r in m8_index.items.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 6: 3, 7: 2}
    info = m8_index.info.first()
    assert (info.levels, info.metric, info.node_size, info.total_clusters, info.dim) == (2, "IP", 2, 4, 2)
    assert {r.leaf: r.n_items for r in stats.occupancy(m8_index).collect()} == {0: 1, 1: 3, 2: 2, 3: 2}


@pytest.mark.parametrize("metric", ["IP", "L2", "COS"])
def test_visit_order(spark, m8, metric):
    index = build_index(m8, IndexConfig(2, 2, metric))
    assert [r.leaf for r in S.visit_order(index, query(spark, (1, 0))).orderBy("leaf_rank").collect()] == [0, 1, 3, 2]


def test_search(spark, m8, m8_index):
    q = query(spark, (1, 0))
    run = lambda *a, **k: ids(S.search(m8_index, q, *a, **k))
    drop = spark.createDataFrame([(2,), (3,)], "item_id bigint")
    assert run(3, 1) == [0, 2, 3]
    assert run(3, 1, drop) == [0, 6, 1]
    assert run(3, 1, drop.select(F.lit(0).cast("bigint").alias("qid"), "item_id")) == [0, 6, 1]
    assert run(3, 1, drop.select(F.lit(5).cast("bigint").alias("qid"), "item_id")) == [0, 2, 3]
    assert run(3, 1, max_increments=0) == [0]
    assert run(3, 1, max_increments=1) == [0, 2, 3]
    assert run(8, 4) == ids(S.brute_force(m8, q, 8, "IP")) == [0, 2, 3, 6, 1, 5, 7, 4]
    assert run(13, 1) == run(8, 4)
    session = S.open_session(m8_index, q, 1, 1)
    assert [ids(session.page(p))[0] for p in range(8)] == [0, 2, 3, 1, 6, 5, 7, 4] and not ids(session.page(8))
    session.close()
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            run(*bad)


def test_queries_in_blocks(spark, m8, m8_index, monkeypatch):
    q = query(spark, *M8)
    want = ids(S.search(m8_index, q, 3, 2)), ids(S.brute_force(m8, q, 3, "IP"))
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    assert (ids(S.search(m8_index, q, 3, 2)), ids(S.brute_force(m8, q, 3, "IP"))) == want


def walk(index, q, metric):
    """Leaves in the order of a best-first walk with a queue."""
    nodes = index.nodes.collect()
    last, full = index.config.levels, {r.leaf for r in index.items.select("leaf").distinct().collect()}
    cost = lambda c: float(M.cost_matrix(metric, np.array([q]), np.array([c]))[0, 0])
    queue, order = [(cost(r.centroid), r.level == last, 1, r.node) for r in nodes if r.level == 1], []
    heapq.heapify(queue)
    while queue:
        _, leaf, level, node = heapq.heappop(queue)
        if leaf:
            if node in full:
                order.append(node)
            continue
        for r in nodes:
            if r.level == level + 1 and r.parent == node:
                heapq.heappush(queue, (cost(r.centroid), level + 1 == last, level + 1, r.node))
    return order


@pytest.mark.parametrize("levels,metric", [(1, "IP"), (2, "L2"), (3, "COS"), (4, "IP"), (5, "L2")])
def test_order_is_that_of_a_walk(spark, levels, metric):
    r = random.Random(levels)
    vectors = [[r.gauss(0, 1) for _ in range(4)] for _ in range(90)]
    index = build_index(frame(spark, vectors), IndexConfig(levels, 3, metric))
    q = [[r.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    got = S.visit_order(index, query(spark, *q)).orderBy("qid", "leaf_rank").collect()
    for k in range(3):
        assert [x.leaf for x in got if x.qid == k] == walk(index, np.array(q[k], np.float32), M.Metric.parse(metric))


def test_properties(spark):
    r = random.Random(9)
    data = frame(spark, [[r.gauss(0, 1) for _ in range(6)] for _ in range(120)]).persist()
    index = build_index(data, IndexConfig(2, 5, "L2"))
    items = index.items.collect()
    assert sorted(x.item_id for x in items) == list(range(120))
    q = query(spark, *[[r.gauss(0, 1) for _ in range(6)] for _ in range(4)])
    exact = S.brute_force(data, q, 10, "L2").persist()
    shares = [S.recall(S.search(index, q, 10, b, max_increments=0), exact).agg(F.avg("recall")).first()[0] for b in (1, 3, 8, 24)]
    assert shares == sorted(shares) and shares[-1] == 1.0
    pool = S.open_session(index, q, 7, 2).pool.collect()
    assert len({(x.qid, x.item_id) for x in pool}) == len(pool) == 480


def test_dead_ends_are_avoided(spark):
    """Unnormalised inner products: a node that attracts all leaves the others
    without children."""
    data = frame(spark, [(1, 0), (10, 1), (0.5, 0.5), (9, -3), (2, 2), (-1, -1), (-3, 1), (0, -2), (1, 1)])
    index = build_index(data, IndexConfig(3, 1, "IP"))
    assert index.items.count() == 9
    assert S.search(index, query(spark, (1, 1)), 9, 1).count() == 9


@pytest.mark.parametrize("part_rows", [100_000, 4])
def test_descent_by_joins_equals_descent_in_memory(spark, monkeypatch, part_rows):
    from vecgrove.operators import assign

    monkeypatch.setattr(assign, "PART_ROWS", part_rows)
    r = random.Random(5)
    data = frame(spark, [[r.gauss(0, 1) for _ in range(4)] for _ in range(60)])
    index = build_index(data, IndexConfig(3, 4, "L2"))
    near = {x.item_id: x.node for x in descend(data, index.nodes, "L2", 3).collect()}
    assert {x.item_id: x.node for x in descend(data, index.nodes, "L2", 3, broadcast_bytes=0).collect()} == near


def test_empty_and_invalid_inputs(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    index = build_index(nothing, IndexConfig(2, 2, "L2"))
    assert index.items.count() == 0 and S.search(index, query(spark, (1, 0)), 3).count() == 0
    for rows in ([(0, [1.0]), (1, [1.0, 2.0])], [(0, [float("nan")])], [(0, None)], [(0, [None])], [(None, [1.0])]):
        with pytest.raises(ValueError):
            validate(spark.createDataFrame(rows, SCHEMA))
    for kwargs in ({"levels": 0}, {"target_cluster_items": 0}, {"metric": "x"}, {"representatives": "x"}):
        with pytest.raises(ValueError):
            IndexConfig(**kwargs)


# ---- keeping, growing, command line


def test_save_append_stream(spark, m8, m8_index, tmp_path):
    from vecgrove.streaming.ingest import ingest, with_stream

    path = f"{tmp_path}/index"
    m8_index.save(path)
    back = VectorIndex.load(spark, path)
    q = query(spark, (1, 0))
    assert ids(S.search(back, q, 8, 4)) == ids(S.search(m8_index, q, 8, 4))
    new = spark.createDataFrame([(100, [0.9, 0.1]), (101, [-0.9, 0.1])], SCHEMA)
    back.append_to(path, new)
    grown = VectorIndex.load(spark, path)
    assert sorted(r.item_id for r in grown.items.collect()) == [*range(8), 100, 101]
    assert {(r.item_id, r.leaf) for r in grown.items.collect()} == {(r.item_id, r.leaf) for r in m8_index.append(new).items.collect()}
    new.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        ingest(stream, back, path, f"{tmp_path}/check").awaitTermination()
    streamed = with_stream(m8_index, path)
    assert sorted(r.item_id for r in streamed.items.collect()) == [*range(8), 100, 101]
    loaded = VectorIndex.load(spark, path)  # appended and streamed
    assert sorted(r.item_id for r in loaded.items.collect()) == [*range(8), 100, 100, 101, 101]
    assert loaded.leaf_sizes.agg(F.sum("n")).first()[0] == 12 and S.search(loaded, q, 12, 1).count() == 12
    VectorIndex.recount(spark, path)
    assert VectorIndex.load(spark, path).leaf_sizes.agg(F.sum("n")).first()[0] == 12
    build_index(m8, IndexConfig(1, 2, "COS", "random", 5)).save(f"{tmp_path}/other")
    assert VectorIndex.load(spark, f"{tmp_path}/other").config == IndexConfig(1, 2, "COS", "random", 5)
    with pytest.raises(FileNotFoundError):
        VectorIndex.load(spark, f"{tmp_path}/none")


def test_reading(spark, m8, tmp_path):
    m8.withColumnRenamed("item_id", "vec_id").write.parquet(f"{tmp_path}/a.parquet")
    assert read_embeddings(spark, f"{tmp_path}/a.parquet").columns == ["item_id", "embedding"]
    with pytest.raises(ValueError):
        read_embeddings(spark, "vectors.csv")
    with pytest.raises(ValueError):
        read_embeddings(spark, f"{tmp_path}/a.parquet", vector_col="other")


def test_command_line(spark, m8, tmp_path, capsys):
    m8.write.parquet(f"{tmp_path}/v.parquet")
    assert main(["build", f"{tmp_path}/v.parquet", "--save-file", f"{tmp_path}/i", "--levels", "2", "--target-cluster-items", "2", "--metric", "ip"]) == 0
    m8.filter("item_id = 0").write.parquet(f"{tmp_path}/q.parquet")
    assert main(["search", f"{tmp_path}/i", f"{tmp_path}/q.parquet", "-k", "3", "--search-exp", "1"]) == 0
    assert [x.split("\t")[2] for x in capsys.readouterr().out.splitlines() if x.count("\t") == 3] == ["0", "2", "3"]
    assert main(["build", f"{tmp_path}/v.csv"]) == 1
    assert main(["build", f"{tmp_path}/v.parquet", "--metric", "other"]) == 1


# ---- cache helpers and plans


def test_eviction_and_preload(spark, m8_index):
    access = spark.createDataFrame([(1, 10), (2, 20), (3, 5), (1, 30), (4, 20)], "n bigint, t bigint")
    assert sorted(r.node for r in stats.eviction_plan(access, 2, "n", "t").collect()) == [2, 3]
    assert stats.preload(m8_index, 1).is_cached
    with pytest.raises(ValueError):
        stats.preload(m8_index, 3)
    border = {r.leaf: (r.border_item, r.n_items) for r in stats.borders(m8_index).collect()}
    assert border[1] == (1, 3) and border[2][1] == 2


def test_assignment_is_map_side(spark, m8, m8_index):
    plan = descend(m8, m8_index.nodes, "IP", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" not in plan


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 100
    assert set(E.oracle_sql()) <= set(E.queries())


def test_registry_needs_no_session():
    import os
    import subprocess
    import sys

    code = "import __spark_entry__ as E; assert set(E.oracle_sql()) <= set(E.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_search_of_a_saved_index_names_its_leaves(spark, m8, m8_index, tmp_path):
    m8_index.save(f"{tmp_path}/i")
    back = VectorIndex.load(spark, f"{tmp_path}/i")
    found = S.search(back, query(spark, (1, 0)), 2, 1, max_increments=0)
    assert ids(found) == [0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(leaf, [0])" in plan or "EqualTo(leaf,0)" in plan or "GreaterThanOrEqual(leaf,0)" in plan
    drop = spark.createDataFrame([(2,), (3,), (2,)], "item_id bigint")
    assert ids(S.search(back, query(spark, (1, 0)), 3, 1, drop)) == [0, 6, 1]


@pytest.mark.parametrize("name", ["topk_ip", "ip_scores", "search_ip", "search_page2", "leaf_visit_order"])
def test_every_asked_row_is_a_query(spark, name):
    from vecgrove import queries as Q

    sf_dir = "/root/testdata/sf0.01"
    want = {r.item_id for r in Q.vectors(spark, sf_dir).filter("item_id % 50 = 0").collect()}
    found = Q.queries()[name](spark, sf_dir)
    assert {r.qid for r in found.select("qid").distinct().collect()} == want and len(want) == 10


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_reaches_nine_tenths(spark, size):
    from vecgrove import queries as Q

    sf_dir, run = f"/root/testdata/{size}", Q.queries()
    for name, metric in (("search_ip", "IP"), ("search_l2", "L2"), ("search_cos", "COS"), ("search_1level", "IP"), ("search_3levels", "IP"), ("search_exclude", "IP")):
        rows = Q.vectors(spark, sf_dir)
        if name == "search_exclude":
            rows = rows.filter(~F.col("item_id").isin(*Q.EXCLUDED))
        exact = S.brute_force(rows, Q.asked(spark, sf_dir), Q.K, metric)
        assert S.recall(run[name](spark, sf_dir), exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_representatives_of_the_whole_table(spark):
    from vecgrove import queries as Q

    sf_dir = "/root/testdata/sf0.01"
    got = Q.queries()["reps_from_table"](spark, sf_dir).collect()
    assert len(got) == Q.vectors(spark, sf_dir).count() == 500 and sorted(r.rep for r in got) == list(range(500))


# ---- identifiers, plans, caches


def test_repeated_and_missing_identifiers(spark):
    """Each input row is an item once; places in the order of identifiers count
    where these have gaps."""
    r = random.Random(3)
    rows = [(k // 3 * 7 + 5, [r.gauss(0, 1) for _ in range(4)]) for k in range(30)]
    data = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for levels, metric in ((1, "IP"), (2, "L2"), (3, "COS")):
        index = build_index(data, IndexConfig(levels, 4, metric))
        assert sorted(x.item_id for x in index.items.collect()) == sorted(i for i, _ in rows)
        assert sorted(x.rep for x in index.reps.collect()) == list(range(8)) and index.leaf_sizes.agg(F.sum("n")).first()[0] == 30
        assert index.append(data).items.count() == 60
        found = S.search(index, query(spark, (1, 0, 0, 0)), 30, 1).collect()
        assert sorted(x.item_id for x in found) == sorted(i for i, _ in rows)
    gaps = R.offset(spark.createDataFrame([(5, [1.0]), (9, [2.0]), (7, [3.0]), (100, [4.0]), (50, [5.0])], SCHEMA), 2)
    assert [(x.rep, x.item_id) for x in gaps.orderBy("rep").collect()] == [(0, 5), (1, 9), (2, 100)]


def test_assignment_has_no_exchange(spark, m8, m8_index):
    plan = m8_index.assign(m8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_descent_by_joins_plans_one_cogroup_a_level(spark):
    r = random.Random(5)
    data = frame(spark, [[r.gauss(0, 1) for _ in range(4)] for _ in range(60)])
    index = build_index(data, IndexConfig(3, 4, "L2"))
    plan = descend(data, index.nodes, "L2", 3, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1  # the levels above are settled


def test_search_ranks_no_more_leaves_than_its_budget(spark, m8_index):
    for df in (S.visit_order(m8_index, query(spark, (1, 0)), 2), S.search(m8_index, query(spark, (1, 0)), 3, 2, max_increments=0)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    order = S.visit_order(m8_index, query(spark, (1, 0)), 2).orderBy("leaf_rank").collect()
    assert [r.leaf for r in order] == [0, 1] and [r.n for r in order] == [1, 3]


@pytest.mark.parametrize("metric", ["IP", "L2", "COS"])
def test_scores_by_products_are_exact(spark, metric):
    """Long vectors close together, ties, and items that are queries."""
    r = np.random.default_rng(2)
    base = r.normal(0, 1000, (40, 8)).astype(np.float32)
    data = np.concatenate([base, base[:10], base[:5] + np.float32(0.01)])
    near = [[float(M.pair_costs(M.Metric.parse(metric), data, base, np.array([j]), np.array([q]))[0]) for j in range(len(data))] for q in range(6)]
    got = S.brute_force(frame(spark, data), query(spark, *base[:6]), 4, metric).orderBy("qid", "rank").collect()
    for q in range(6):
        want = sorted((c, j) for j, c in enumerate(near[q]))[:4]
        assert [(x.dist, x.item_id) for x in got if x.qid == q] == want
    step = M.best_pairs(M.Metric.parse(metric), np.arange(len(data)), data, base[:6], 4, cells=12)
    for q in range(6):
        assert {j for one, j in zip(step[0], step[1]) if one == q} >= {j for _, j in sorted((c, j) for j, c in enumerate(near[q]))[:4]}


def test_many_pairs_are_joined(spark, m8, m8_index, monkeypatch):
    q = query(spark, *M8)
    want = S.search(m8_index, q, 3, 2).orderBy("qid", "rank").collect()
    monkeypatch.setattr(S, "SENT_PAIRS", 1)
    got = S.search(m8_index, q, 3, 2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.rank, r.item_id) for r in got] == [(r.qid, r.rank, r.item_id) for r in want]


def test_node_cache(spark, m8_index):
    cache = stats.NodeCache(m8_index, prefetch=1).wait()
    assert cache.is_loaded(1) and not cache.is_loaded(2) and cache.loaded_nodes() == 2
    assert {(r.level, r.node): r.loaded for r in cache.state().collect()} == {(1, 0): True, (1, 1): True, **{(2, k): False for k in range(4)}}
    cache.load(2)
    assert cache.loaded_nodes() == 6 and cache.nodes.count() == 6
    cache.clear(1)
    assert cache.loaded_nodes() == 4 and not cache.is_loaded(1)
    cache.clear()
    assert cache.loaded_nodes() == 0 and not any(r.loaded for r in cache.state().collect()) and cache.nodes.count() == 6
    for bad in (0, 3):
        with pytest.raises(ValueError):
            cache.load(bad)


def test_mini_batches(spark):
    """Against plain mini-batch k-means over the same slices."""
    r = random.Random(8)
    rows = [[r.gauss(0, 1) for _ in range(3)] for _ in range(60)]
    data = frame(spark, rows)
    keyed = data.select("item_id", F.pmod(F.xxhash64("item_id", F.lit(4)), F.lit(3)).alias("s")).collect()
    centres = {x.rep: np.array(x.embedding, float) for x in R.random(data, 5, 4).collect()}
    seen = dict.fromkeys(centres, 0)
    for k in range(3):
        sums, n = {c: np.zeros(3) for c in centres}, dict.fromkeys(centres, 0)
        for i in (x.item_id for x in keyed if x.s == k):
            v = np.array(rows[i], np.float32).astype(float)
            c = min(centres, key=lambda c: (np.linalg.norm(centres[c] - v), c))
            sums[c] += v
            n[c] += 1
        for c in centres:
            if n[c]:
                centres[c] = (centres[c] * seen[c] + sums[c]) / (seen[c] + n[c])
                seen[c] += n[c]
    got = {x.rep: x.embedding for x in R.kmeans(data, 5, 4, slice_rows=20).collect()}
    assert set(got) == set(centres) and all(np.allclose(got[c], centres[c], atol=1e-5) for c in centres)


def test_rows_are_identifiers(spark, m8, tmp_path):
    m8.orderBy("item_id").select("embedding", (-F.col("item_id")).alias("key")).coalesce(1).write.parquet(f"{tmp_path}/n.parquet")
    got = {tuple(np.round(r.embedding, 4)): r.item_id for r in read_embeddings(spark, f"{tmp_path}/n.parquet").collect()}
    assert [got[tuple(map(float, v))] for v in M8] == list(range(8))
    back = {tuple(np.round(r.embedding, 4)): r.item_id for r in read_embeddings(spark, f"{tmp_path}/n.parquet", order_by=["key"]).collect()}
    assert [back[tuple(map(float, v))] for v in M8] == list(range(7, -1, -1))


def test_representatives_from_a_file(spark, m8, tmp_path, caplog):
    from vecgrove.sources.embeddings import read_representatives

    m8.write.parquet(f"{tmp_path}/v.parquet")
    reps = m8.filter("item_id in (1, 4, 6)").select((F.col("item_id") * 10).alias("ids"), F.col("embedding").alias("vecs"))
    reps.write.parquet(f"{tmp_path}/reps")
    assert sorted(r.item_id for r in read_representatives(spark, f"{tmp_path}/reps", "vecs", "ids").collect()) == [10, 40, 60]
    args = ["--save-file", f"{tmp_path}/i", "--levels", "1", "--metric", "L2", "--file-store", "parquet"]
    assert main(["build", f"{tmp_path}/v.parquet", *args, "--rep-file", f"{tmp_path}/reps", "--rep-emb-grp", "vecs", "--rep-ids-grp", "ids", "--rep-file-store", "parquet"]) == 0
    index = VectorIndex.load(spark, f"{tmp_path}/i")
    assert sorted(r.item_id for r in index.reps.collect()) == [10, 40, 60] and index.items.count() == 8
    assert main(["build", f"{tmp_path}/v.parquet", "--rep-file", f"{tmp_path}/none"]) == 1


def test_log_goes_where_it_is_sent(tmp_path):
    import logging

    from vecgrove.cli import enable_logging, log, timed

    before = list(log.handlers)
    enable_logging(f"{tmp_path}/log.txt")
    with timed("counting"):
        pass
    for h in [h for h in log.handlers if h not in before]:
        h.flush()
        log.removeHandler(h)
    assert "counting took" in open(f"{tmp_path}/log.txt").read() and log.level == logging.INFO
