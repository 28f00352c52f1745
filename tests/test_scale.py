"""What grows with the table: no pair of query and leaf is a row, no item is ranked that isn't shown."""

import numpy as np
import pytest

from vecgrove.functions import metrics as M
from vecgrove.operators import search as S
from vecgrove.plans.index import IndexConfig, build_index


def table(spark, n, dim=6, seed=1, copies=0):
    data = np.round(np.random.default_rng(seed).normal(size=(n, dim)), 3).astype("float32")
    data[:copies] = data[0]
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(data)], "item_id bigint, embedding array<float>")


def asked(vectors, every=7):
    return vectors.filter(f"item_id % {every} = 0").selectExpr("item_id qid", "embedding qv")


def rows(df):
    return sorted(map(tuple, df.select("qid", "rank", "item_id", "dist").collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("levels,metric", [(1, "IP"), (2, "L2"), (3, "COS")])
def test_large_budgets_are_not_listed_leaf_by_leaf(spark, monkeypatch, levels, metric):
    v = table(spark, 400, copies=60)
    index, q = build_index(v, IndexConfig(levels, 8, metric)), asked(v)
    drop = v.filter("item_id in (0, 7, 9)").select("item_id")
    runs = [lambda: S.search(index, q, 5, 20, max_increments=0), lambda: S.search(index, q, 40, 3), lambda: S.search(index, q, 40, 2, drop, 2)]
    few = [rows(r()) for r in runs]
    monkeypatch.setattr(S, "SENT_PAIRS", 10)
    for run, expected in zip(runs, few):
        found = run()
        assert "Join Inner" not in plan(found)
        assert rows(found) == expected


def test_the_tree_is_sent_once(spark, monkeypatch):
    v = table(spark, 400)
    index, q = build_index(v, IndexConfig(2, 8, "IP")), asked(v)
    monkeypatch.setattr(S, "SENT_PAIRS", 10)
    monkeypatch.setattr(S, "QUERY_BLOCK", 20)
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    in_blocks = rows(S.search(index, q, 5, 20, max_increments=0))
    assert sum(isinstance(x, S.Tree) for one in sent for x in (one if isinstance(one, tuple) else (one,))) == 1
    monkeypatch.setattr(S, "QUERY_BLOCK", 10_000)
    assert in_blocks == rows(S.search(index, q, 5, 20, max_increments=0))


def test_sort_keys_keep_the_suffix_maxima():
    rng = np.random.default_rng(3)
    costs = [rng.integers(0, 4, (2, 5)).astype(float) for _ in range(4)]
    key = S.sort_keys(costs)
    for q in range(2):
        for leaf in range(5):
            path = [c[q, leaf] for c in costs]
            kept = [x for k, x in enumerate(path) if x >= max(path[k:])]
            assert key[:, q, leaf].tolist() == kept + [-np.inf] * (4 - len(kept))


@pytest.mark.parametrize("metric", list(M.Metric))
def test_running_best_is_the_best_of_all(metric):
    rng = np.random.default_rng(4)
    data, q = rng.normal(size=(900, 8)).astype("float32"), rng.normal(size=(13, 8)).astype("float32")
    data[100:300], data[5] = data[7], 0
    ids, may, group = rng.permutation(900), rng.random((13, 30)) < 0.3, rng.integers(0, 30, 900)
    exact = M.pair_costs(metric, q, data, *np.divmod(np.arange(13 * 900), 900)).reshape(13, 900)
    for which in (None, may):
        best = M.Best(metric, q, 6, cells=13 * 50)
        for at in range(0, 900, 200):
            best.add(ids[at : at + 200], data[at : at + 200], which, group[at : at + 200])
        for k in range(13):
            rows_ = np.arange(900) if which is None else np.flatnonzero(may[k, group])
            order = rows_[np.lexsort((ids[rows_], exact[k, rows_]))][:6]
            assert best.ids[k].tolist() == ids[order].tolist()
            assert best.cost[k].tolist() == exact[k, order].tolist()
    nearest = M.nearest_rows(metric, q, data, cells=13 * 10)
    assert nearest.tolist() == exact.argmin(axis=1).tolist()


def test_pages_need_no_more_than_they_show(spark, monkeypatch):
    v = table(spark, 300, copies=40)
    index, q = build_index(v, IndexConfig(2, 8, "IP")), asked(v)
    twice = S.open_session(index, q.unionByName(q.filter("qid = 7")), 4, 2).pool  # an identifier twice
    assert twice.filter("qid = 7").count() == 600 and twice.filter("qid = 7").distinct().count() == 600
    drop = v.filter("item_id in (0, 7, 9)").select("item_id")
    for exclude, most in ((None, -1), (drop, -1), (None, 1)):
        one = S.open_session(index, q, 4, 2, exclude, most)
        assert "Window" not in plan(one.page(1)) and one._kept.count() <= 2 * 4 * 43
        shown = {p: rows(one.page(p)) for p in (0, 1, 5)}
        full = rows(one.pool)
        with monkeypatch.context() as m:
            m.setattr(S, "TABLE_BYTES", 0)
            plain = S.open_session(index, q, 4, 2, exclude, most)
            assert "Window" in plan(plain.pool) and [x[:3] for x in rows(plain.pool)] == [x[:3] for x in full]
        for p, x in shown.items():
            assert x == [r for r in full if 4 * p < r[1] <= 4 * p + 4]
        one.close()


def test_exact_search_sends_on_k_items_a_task(spark):
    v = table(spark, 3000, copies=100).repartition(1)
    found = S.brute_force(v, asked(v, 20), 3, "L2")
    moved = found._jdf.queryExecution().optimizedPlan()
    expected = S.brute_force(v.repartition(3), asked(v, 20), 3, "L2")
    assert rows(found) == rows(expected)
    assert "Repartition 4" in moved.toString()


@pytest.mark.parametrize("metric", ["IP", "L2", "COS"])
def test_scores_of_all_pairs_are_dealt_over_tasks(spark, monkeypatch, metric):
    v = table(spark, 600, copies=50).repartition(1)
    q = asked(v, 20)
    assert S.all_scores(v, q, metric).rdd.getNumPartitions() == 4  # cores
    monkeypatch.setattr(S, "TASK_PAIRS", 3000)
    found = S.all_scores(v, q, metric)
    assert found.rdd.getNumPartitions() == 6
    data = np.array([r.embedding for r in v.orderBy("item_id").collect()])
    got = {(r.qid, r.item_id): r.value for r in found.collect()}
    assert len(got) == found.count() == 600 * 30
    for (one, item), value in got.items():
        a, b = data[one], data[item]
        want = {"IP": a @ b, "L2": np.linalg.norm(a - b), "COS": a @ b / np.linalg.norm(a) / np.linalg.norm(b)}[metric]
        assert abs(value - want) < 1e-12 * (1 + abs(want))
    assert got[0, 49] == 0 or metric != "L2"
    assert S.all_scores(v, q.limit(0), metric).count() == 0
