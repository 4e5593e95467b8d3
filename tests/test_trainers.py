"""Steps of the trainers: a step's cost and effect are those of its batch's rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wordloom.operators import corpus, models, slabs, trainers

D = models.Space(16, 4)


def test_rows_that_share_a_subject_move_as_rows_of_their_own():
    rng = np.random.default_rng(2)
    parts = [rng.normal(0, 0.3, size=(n, 8)) for n in (5, 7, 2)]
    i, j, k = rng.integers(5, size=6), rng.integers(7, size=(6, 4)), rng.integers(2, size=6)
    label = trainers._labels(j)
    one, two = ([x.copy() for x in parts] for _ in range(2))
    touched = trainers.bound_step(*one, i, j, k, label, 0.2)
    trainers.bound_step(*two, np.repeat(i, 4), j.ravel(), np.repeat(k, 4), label.ravel(), 0.2)
    assert all(np.allclose(x, y, atol=1e-6) for x, y in zip(one, two))
    assert [int(n.sum()) for _, n in touched] == [24, 24, 24]
    assert all((np.setdiff1d(np.arange(len(x)), rows) == np.flatnonzero((x == x0).all(axis=1))).all() for x, x0, (rows, _) in zip(one, parts, touched))


def test_a_step_leaves_other_rows_alone(monkeypatch):
    """Nothing as long as the matrices is made: they may be as large as the vocabulary."""
    big = [np.broadcast_to(np.float32(0.1), (1 << 40, 4)) for _ in range(2)]
    seen = []
    monkeypatch.setattr(trainers, "_added", lambda m, at, move, times=1, power=0.5: seen.append((at.max(), move.shape)) or (at, at))
    trainers._step(big, np.array([1 << 39, 3]), np.array([[5, 1 << 38], [6, 7]]), 0.1)
    assert seen == [(1 << 39, (2, 4)), (1 << 38, (4, 4))]


def test_draws_follow_the_weights():
    n = np.bincount(trainers._draws(np.random.default_rng(1), np.cumsum([1.0, 0.0, 3.0]), 40_000), minlength=3)
    assert n[1] == 0 and abs(n[2] / n[0] - 3) < 0.2


def test_neighbours_are_those_of_the_windows(spark):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "x"], n))) for i, n in enumerate([0, 1, 2, 3, 9, 20])], "doc_id long, text string")
    vocabulary = corpus.vocabulary(corpus.postings(docs), 2, min_length=2)
    want = sorted((r.term, r.other) for r in corpus.window_pairs(corpus.tokens(docs), vocabulary, 2).collect())
    words = [(r.doc_id, w) for r in docs.collect() for w in r.text.split() if len(w) > 1]
    names = sorted({w for _, w in words})
    i, j = trainers.neighbours(np.array([names.index(w) for _, w in words]), np.array([d for d, _ in words]), 2)
    assert sorted((names[x], names[y]) for x, y in zip(i, j)) == want


def test_documents_are_read_as_numbers(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "aa xx bb xx" if i % 2 else "cc yy dd yy") for i in range(200)], "doc_id long, text string")
    held = slabs.vocabulary(slabs.counts(docs), F.lit(1.0), models.places(F.col("term"), D))
    monkeypatch.setattr(trainers, "LEAST", 1000)
    v = {r.object: np.array(r.vec) for r in trainers.skip_gram_of_documents(docs, held, 1, 8, 20, 3, 0.5, 32).collect()}
    cos = lambda p, q: v[p] @ v[q] / np.linalg.norm(v[p]) / np.linalg.norm(v[q])
    assert len(v) == 6 and cos("aa", "bb") > cos("aa", "cc") and cos("cc", "dd") > cos("bb", "dd")
    empty = slabs.Vocabulary(pa.array([], pa.string()), np.zeros(0, int), np.zeros(0), np.zeros((0, 4), int))
    assert trainers.skip_gram_of_documents(docs, empty, 1, 8).count() == 0
