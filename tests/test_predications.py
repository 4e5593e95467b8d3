"""Predication vectors held against sums of bound elemental vectors, triple by triple."""

from collections import Counter
from math import log10

import numpy as np
import pytest

from wordloom.operators import models, predications, rows
from wordloom.plans import catalog

SF = "/root/testdata/sf0.001"
D = models.Space(16, 4)


@pytest.fixture
def triples(spark):
    """(distinct triples with their counts, written as a table, the counts)."""
    rng = np.random.default_rng(3)
    drawn = [(f"s{rng.integers(8)}", ("LIKES", "HAS", "IN_REGION")[rng.integers(3)], f"{'so'[rng.integers(2)]}{rng.integers(8)}") for _ in range(150)]
    counts = Counter(drawn)
    return spark.createDataFrame([(*t, n) for t, n in counts.items()], "subject string, predicate string, object string, n long"), counts


def expected(counts):
    n = len(counts)
    idf = [{k: log10(n / c) for k, c in Counter(t[x] for t in counts).items()} for x in range(3)]
    items, kinds = {}, {}
    def add(to, key, one, two, w, shift=0):
        val, there = rows.bound(one, two, D)
        v, k = to.setdefault(key, (np.zeros(16), np.zeros(16, bool)))
        v += w * np.roll(val, shift)
        k |= np.roll(there, shift)
    for (s, p, o), c in counts.items():
        add(items, s, o, p, log10(1 + c) * (idf[2][o] + idf[1][p]))
        add(items, o, s, f"{p}-INV", log10(1 + c) * (idf[0][s] + idf[1][p]))
        for q in (p, f"{p}-INV"):
            add(kinds, q, s, o, idf[0][s] * idf[2][o], 1)
    return [{(k, i): x for k, (v, t) in to.items() for i, x in enumerate(v / (np.linalg.norm(v) or 1)) if t[i]} for to in (items, kinds)]


def test_vectors_are_sums_of_bound_arguments(triples):
    df, counts = triples
    items, kinds = expected(counts)
    got = predications.items(df, D)
    assert {(r.object, r.dim): r.val for r in got.collect()} == pytest.approx(items)
    assert {(r.object, r.dim): r.val for r in predications.predicates(df, D).collect()} == pytest.approx(kinds)
    # a triple stays one row each way: it is not expanded to a row for each pair of places
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_few_items_have_the_vectors_of_all(spark, triples):
    df, counts = triples
    some = spark.createDataFrame([("s1",), ("o2",)], "item string")
    items = {k: v for k, v in expected(counts)[0].items() if k[0] in ("s1", "o2")}
    assert {(r.object, r.dim): r.val for r in predications.items(df, D, some).collect()} == pytest.approx(items)


def test_few_items_are_kept_before_anything_is_joined(spark, triples):
    df, _ = triples
    some = spark.createDataFrame([("s1",), ("o2",)], "item string")
    plan = predications.items(df, D, some)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    inner, semi = ([depth(x) for x in plan if kind in x] for kind in ("Join Inner, (object", "Join LeftSemi"))
    assert len(semi) == 2 and inner and min(semi) > max(inner)
    # and the rows of an item are summed where they are, before they meet in one task
    shuffle = next(i for i, x in enumerate(plan) if "Repartition" in x)
    assert sum("MapInArrow" in x for x in plan[shuffle:]) == 1


def test_lines_are_counted_before_suppliers_are_joined(spark):
    df = catalog.counted_triples(spark, SF)
    assert {r["count"] for r in df.groupBy("subject", "predicate", "object").count().collect()} == {1}
    assert df.where("predicate = 'SUPPLIES'").groupBy().sum("n").first()[0] == spark.read.parquet(f"{SF}/lineitem.parquet").count()
