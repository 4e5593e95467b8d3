"""Term and document vectors as products with the packed corpus matrix, held against the joins of models.py and the SQL."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordloom.operators import corpus, matrices, models, slabs
from wordloom.plans import catalog

SF = "/root/testdata/sf0.001"
D = models.Space(16, 4)


@pytest.fixture
def parts(spark):
    """(index, postings, vocabulary, weights, documents) of a few documents in several partitions."""
    rng = np.random.default_rng(5)
    words = ["aa", "bb", "cc", "dd", "x", *(f"w{chr(97 + i)}" for i in range(20))]
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(30)]
    docs = spark.createDataFrame([*texts, (98, None), (99, ""), (97, "aa aa")], "doc_id long, text string")
    tf, vocabulary = models.corpus_space(docs, 2)
    idf = F.log10(F.lit(31) / F.col("df"))
    held = slabs.vocabulary(corpus.filtered(slabs.counts(docs), 2, min_length=2), idf, models.places(F.col("term"), D))
    return matrices.index(docs, held), tf, vocabulary, vocabulary.select("term", idf.alias("weight")), docs


def same(got, want):
    x, y = ({(r.object, r.dim): r.val for r in df.select("object", "dim", "val").collect()} for df in (got, want))
    assert x.keys() == y.keys() and all(x[k] == pytest.approx(y[k], abs=1e-9) for k in x)


def test_terms_by_their_documents(parts):
    ix, tf, vocabulary, weights, _ = parts
    assert ix.slabs.count() > 3
    first = models.normalised(models.term_vectors(tf, vocabulary, D))
    elemental, seeded = matrices.Documents("elemental", D), matrices.Documents("seeded", D)
    same(matrices.terms(ix, elemental), first)
    documents = models.normalised(models.seeded_documents(tf, weights, D, F.col("tf")))
    same(matrices.terms(ix, seeded), models.normalised(models.terms_from_documents(tf, vocabulary, documents, D)))
    same(matrices.terms(ix, seeded, local="log"), models.normalised(models.incremental_terms(tf, vocabulary, documents, F.log10(1 + F.col("tf")), D)))
    same(matrices.terms(ix, matrices.Documents("symmetric", D)), models.normalised(models.symmetric(tf, weights, D)))
    same(matrices.term_signs(ix, elemental).withColumnRenamed("bit", "val"), models.signs(models.term_vectors(tf, vocabulary, D)).withColumnRenamed("bit", "val"))
    store = {r.object: r.vec for r in matrices.term_store(ix, elemental).collect()}
    assert all(store[r.object] == pytest.approx(r.vec) for r in models.dense(first, D).collect())


def test_documents_by_their_terms(parts):
    ix, tf, vocabulary, weights, docs = parts
    m, how = matrices.term_matrix(ix, matrices.Documents("elemental", D)), matrices.Documents("terms", D)
    first = models.normalised(models.term_vectors(tf, vocabulary, D))
    want = models.normalised(models.document_vectors(tf, weights, first, F.col("tf"), D)).cache()
    same(matrices.documents(ix, how, m), want)
    same(matrices.terms(ix, how, m), models.normalised(models.terms_from_documents(tf, vocabulary, want, D)))
    store = {r.object: r.vec for r in matrices.document_store(ix, how, m).collect()}
    assert store.keys() == {r.doc_id for r in docs.collect()} and all(store[r.object] == pytest.approx(r.vec, abs=1e-9) for r in models.dense(want, D).collect())
    q = {r.dim: r.val for r in want.collect() if r.object == 7}
    x = want.where(F.col("dim").isin(list(q))).collect()
    hits = {r.object: r.x for r in matrices.document_products(ix, how, m, "7").collect()}
    assert hits == pytest.approx({o: sum(r.val * q[r.dim] for r in x if r.object == o) for o in {r.object for r in x}})
    assert matrices.document_products(ix, how, m, "12345").count() == 0


def alike(got, want, k):
    """The same components, each up to its sign."""
    x, y = ({(r.object, r.component): r.val for r in df.collect()} for df in (got, want))
    assert x.keys() == y.keys() and len(x) > k
    for c in range(k):
        own = sorted(o for o, i in x if i == c)
        u, v = (np.array([m[o, c] for o in own]) for m in (x, y))
        assert np.allclose(u * np.sign(u @ v), v, atol=1e-7)


def test_decomposition_reads_packed_slabs(spark, parts):
    from wordloom.operators import analysis
    from wordloom.plans import registry

    ix, tf, vocabulary, weights, _ = parts
    matrix = lambda tf, weights: tf.join(weights, "term").select(F.col("term").alias("object"), F.col("doc_id").alias("column"), (F.log10(1 + F.col("tf")) * F.col("weight")).alias("val"))
    alike(analysis.decomposition_of_documents(ix, k=3, extra=4), analysis.decomposition(matrix(tf, weights), 3, extra=4), 3)
    assert analysis.decomposition_of_documents(matrices.index(parts[4].where("doc_id < 0"), ix.vocabulary)).where("val <> 0").count() == 0
    got = catalog.QUERIES["latent_semantic_analysis"](spark, SF)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    alike(got, analysis.decomposition(matrix(registry.space(spark, SF)[0], registry.weights(spark, SF))), 16)


def test_packed_columns_come_back():
    x = np.random.default_rng(1).integers(0, 1 << 32, (3, 500))
    assert (matrices.unpacked(matrices.packed(*x), 3, 500) == x).all() and matrices.unpacked(matrices.packed(x[0, :0]), 1, 0).size == 0


QUERIES = ["reflective_term_seed", "training_cycles", "incremental_document_vectors", "reflective_second_cycle", "incremental_term_vectors", "symmetric_ri", "ri_document_vectors", "ri_binary_term_vectors", "ri_term_vectors"]


@pytest.mark.parametrize("name", QUERIES)
def test_no_postings_are_joined(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    got, want = df.toPandas(), con.execute(catalog.ORACLES[name]).df()
    keys = sorted(got.columns)
    sort = lambda p: p[keys].sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(got), sort(want), check_dtype=False)
    assert "SortMergeJoin" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "HashAggregate" not in plan


def test_ranks_of_analogies_are_counted_in_blocks(spark):
    from wordloom.operators import analysis

    m = np.random.default_rng(4).normal(size=(300, 8)).round(1)
    m[10] = m[20] = m[103]  # ties with an answer
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "object long, vec array<double>")
    cues = [(100, 101, 102, 103), (200, 201, 202, 203), (7, 7, 9, 7)]
    found = analysis.analogies(store, spark.createDataFrame(cues, "a long, b long, c long, d long"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r.a, r.d): r["rank"] for r in found.collect()}
    for a, b, c, d in cues:
        q = u[b] - u[a] + u[c]
        s = np.round(u @ q / np.linalg.norm(q), 6)
        assert got[a, d] == 1 + sum(1 for i in range(300) if i not in (a, b, c) and (s[i] > s[d] or s[i] == s[d] and i < d))


def test_clusters_read_packed_blocks(spark):
    from wordloom.operators import analysis

    store = spark.createDataFrame([(i, [1.0, 0.01 * i] if i % 2 else [-1.0, 0.02 * i]) for i in range(40)], "object long, vec array<double>")
    assert sorted(x for r in analysis.packed_units(store).collect() for x in r.objects) == list(range(40))
    at = {r.object: r.cluster for r in analysis.k_means(store, 2).collect()}
    assert len({at[i] for i in range(1, 40, 2)}) == 1 and len(at) == 40
    assert analysis.k_means(store.where("object < 0")).count() == 0
