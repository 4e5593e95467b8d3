"""Batch search block by block, held against all pairs."""

import numpy as np

from wordloom.operators import search


def test_blocks_find_the_best_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 40)
    m = np.random.default_rng(3).normal(size=(301, 8)).round(1)
    m[50:60] = m[7]  # more equal rows than are kept
    m[100] = 0
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "object long, vec array<double>")
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -np.inf)
    found = search.batch(store, store.selectExpr("object as query", "vec as q").where("query % 3 = 0"))
    got = {(r["query"], r["rank"]): (r.object, r.score) for r in found.collect()}
    want = {(q, n + 1): (int(o), s[q, o]) for q in range(0, 301, 3) for n, o in enumerate(np.lexsort((np.arange(301), -s[q]))[:5])}
    assert got == want
    # blocks are not gathered in lists, nor joined by a key
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortMergeJoin" not in plan


def test_a_block_smaller_than_what_is_kept():
    top, who = np.full((2, 5), -np.inf), np.zeros((2, 5), np.int64)
    u = np.eye(3)
    search._bettered(top, who, np.array([0, 9]), u[:2], np.arange(3), u)
    assert who[0, :2].tolist() == [1, 2] and np.isneginf(top[0, 2:]).all() and who[1, :3].tolist() == [1, 0, 2]
