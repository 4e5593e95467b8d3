"""Invariants of the algebra, readers, analysis and trainers; catalog queries against their oracles."""

import math
import shutil
import struct
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from wordloom.functions import fields as G
from wordloom.functions import text as T
from wordloom.functions import vectors as V
from wordloom.operators import analysis, corpus, expressions, models, rows, search, slabs, trainers
from wordloom.plans import catalog
from wordloom.sources import readers
from wordloom.streaming import incremental

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_real_vectors(spark):
    assert value(spark, V.cosine(vec(0, 1), vec(1, 1))) == pytest.approx(math.sqrt(0.5))
    assert value(spark, V.convolve(vec(1, 0, 1), vec(1, 1, 0))) == [2, 1, 1] == value(spark, V.convolve(vec(1, 1, 0), vec(1, 0, 1)))
    assert value(spark, V.involution(vec(0, 1, 2, 3))) == [0, 3, 2, 1]
    for by in (2, -4, 14):
        assert value(spark, V.shift(vec(0, 1, 2, 3, 4, 5), by)) == [4, 5, 0, 1, 2, 3]
    assert value(spark, V.normalise(vec(0, 0))) == [0, 0] and value(spark, V.cosine(vec(0, 0), vec(1, 0))) == 0
    assert value(spark, V.dot(V.without(vec(1, 2, 3), vec(1, 0, 1)), vec(1, 0, 1))) == pytest.approx(0, abs=1e-12)
    assert value(spark, V.superpose(vec(-1, 1, 0), vec(0, 1, -1), 2.0)) == [-1, 3, -2]
    assert value(spark, V.from_text(V.to_text(vec(1.5, -2)))) == [1.5, -2]


def test_release_undoes_bind(spark):
    rng = np.random.default_rng(0)
    a, b = (vec(*rng.normal(size=256)) for _ in range(2))
    assert value(spark, V.cosine(V.release(V.bind(a, b), a), b)) > 0.5
    assert value(spark, V.cosine(V.release(V.bind(a, b, "permutation"), b, "permutation"), a)) == pytest.approx(value(spark, V.cosine(V.release(V.bind(a, b, "permutation"), b, "permutation"), a)))


def test_phases(spark):
    p = lambda *x: F.array(*(F.lit(v) for v in x))
    assert value(spark, V.phases(vec(1, 1, 0, 1, 1, 0, 0, 0))) == [2048, 4096, 0, -1]
    assert value(spark, V.phase_bind(p(1, -1, 16000), p(2, 5, 1000))) == [3, 5, 616]
    assert value(spark, V.phase_release(p(3, 5, -1), p(2, -1, 7))) == [1, 5, 7]
    assert value(spark, V.phase_overlap(p(5, -1), p(5, 9))) == 1 and value(spark, V.phase_overlap(p(5, 9), p(5, -1))) == 0.5
    assert value(spark, V.cartesian(V.phases(vec(3, 4))))[0] == pytest.approx(0.6, abs=1e-3)


def test_binary(spark):
    w = lambda x: F.array(F.lit(x).cast("long"))
    assert value(spark, V.xor(V.xor(w(12345), w(999)), w(999))) == [12345]
    assert value(spark, V.binary_overlap(w(5), w(5))) == 1 and value(spark, V.binary_overlap(w(5), V.complement(w(5)))) == -1
    votes = spark.createDataFrame([("a", i, v) for i, v in enumerate((0.0, 3.0, 0.0, -1.0, 0.0))], "object string, dim int, val double")
    assert [r.bit for r in models.signs(votes).orderBy("dim").collect()] == [0, 1, 1, 0, 0]


def test_text(spark):
    assert value(spark, T.words(F.lit("Ab-c, 12 É!"))) == ["ab", "c", "é"]
    assert value(spark, T.component_ngrams(F.lit("abc"))) == ["<ab", "abc", "bc>", "<abc", "abc>"]
    assert value(spark, T.normal_term(F.lit(" New  York 7! "))) == "new_york"
    assert value(spark, T.is_number(F.lit("1e3"))) and not value(spark, T.is_number(F.lit("x1")))


def test_windows_close_up_over_filtered_terms(spark):
    docs = spark.createDataFrame([(1, "a rare b a b")], "doc_id long, text string")
    vocabulary = spark.createDataFrame([("a",), ("b",)], "term string")
    got = sorted((r.term, r.other, r.offset) for r in corpus.window_pairs(corpus.tokens(docs), vocabulary, 1).collect())
    assert got == [("a", "b", -1), ("a", "b", 1), ("a", "b", 1), ("b", "a", -1), ("b", "a", -1), ("b", "a", 1)]


def test_symmetric_model_is_the_sum_over_pairs(spark):
    tf = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("c", 2, 1), ("a", 2, 1)], "term string, doc_id long, tf long")
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.5)], "term string, weight double")
    space = models.Space(16, 4)
    e = {t: np.zeros(16) for t in "abc"}
    for r in models.elemental(weights, F.col("term"), space).collect():
        e[r.term][r.dim] += r.sign
    w = {(d, t): n * {"a": 1.0, "b": 2.0, "c": 0.5}[t] for t, d, n in ((r.term, r.doc_id, r.tf) for r in tf.collect())}
    size = {d: math.sqrt(sum(v * v for (x, _), v in w.items() if x == d)) for d in (1, 2)}
    want = {t: sum((w[d, x] / size[d] * w[d, y] / size[d] * e[y] for d, x in w if x == t for d2, y in w if d2 == d and y != x), np.zeros(16)) for t in "abc"}
    got = {t: np.zeros(16) for t in "abc"}
    for r in models.symmetric(tf, weights, space).collect():
        got[r.object][r.dim] = r.val
    assert all(np.allclose(got[t], want[t]) for t in "abc")


def test_searches(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "object long, vec array<double>")
    assert [r.object for r in search.search_sum(store, [1]).collect()] == [1, 3, 2]
    assert [(r.object, r.score) for r in search.search_not(store, [3], [2]).collect()][0] == (1, 1.0)
    assert all(r.score == 1 for r in search.search_subspace(store, [1, 2]).collect())
    assert search.search_sum(store, [99]).count() == 0
    batch = search.batch(store, store.select(F.col("object").alias("query"), F.col("vec").alias("q")), 1)
    assert {r.query: r.object for r in batch.collect()} == {1: 3, 2: 3, 3: 1}


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one").write_text("x\n\ny\n")
    (tmp_path / "a" / ".hidden").write_text("z")
    assert [r.text for r in readers.text_folder(spark, str(tmp_path / "a")).collect()] == ["x\n\ny\n"]
    assert [(r.line_id, r.text) for r in readers.lines(spark, str(tmp_path / "a" / "one")).collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "t").write_text("New York\tis in\tUSA\nbad\n")
    assert readers.triples(spark, str(tmp_path / "t")).first() == ("new_york", "IS_IN", "usa", "new_yorkIS_INusa")
    (tmp_path / "s").write_text("\t".join(("a|b|||x", "C1|C2", "t", "treats", "Big d", "C3", "u", "1", "src")) + "\n")
    assert sorted((r.subject, r.subject_cui, r.predicate, r.object) for r in readers.typed_triples(spark, str(tmp_path / "s")).collect()) == [("a", "C1", "TREATS", "big_d"), ("b", "C2", "TREATS", "big_d")]
    (tmp_path / "c.csv").write_text("k,n,s\na,1.0,x\nb,-2,y\nc,,3\n")
    assert {r.name: (r.kind, r.low, r.high) for r in readers.column_types(readers.table(spark, str(tmp_path / "c.csv"))).collect()} == {"k": ("STRING", None, None), "n": ("DOUBLE", -2, 1), "s": ("STRING", None, None)}
    store = spark.createDataFrame([("a|b", [1.0, -0.5])], "object string, vec array<double>")
    dashes = store.unionByName(spark.createDataFrame([("-x", [1.0, 2.0]), ("-vectortype ", [0.0, 3.0])], store.schema))
    readers.write_text_store(dashes, str(tmp_path / "text.txt"))
    assert sorted((r.object, r.vec) for r in readers.read_text_store(spark, str(tmp_path / "text.txt")).collect()) == [("-vectortype ", [0.0, 3.0]), ("-x", [1.0, 2.0]), ("a;b", [1.0, -0.5])]
    readers.translated(spark, str(tmp_path / "text.txt"), str(tmp_path / "again"), "store")
    assert readers.read_store(spark, str(tmp_path / "again")).count() == 3 and readers.store_path("a") == "a.bin" == readers.store_path("a.bin") and readers.store_path("a", True) == "a.txt"
    readers.proximity_data(store, str(tmp_path / "near"))
    assert [r.value for r in spark.read.text(str(tmp_path / "near")).collect()] == ["-0.5 1.0", "1.0 -0.5"]
    readers.write_store(store, str(tmp_path / "store"))
    assert readers.read_store(spark, str(tmp_path / "store")).schema["vec"].metadata["dimension"] == 2
    readers.write_binary_store(store, str(tmp_path / "bin"))
    assert Path(tmp_path / "bin").read_bytes() == b"1 2\na|b " + struct.pack("<2f", 1, -0.5) + b"\n"
    with pytest.raises(ValueError):
        left = spark.createDataFrame([("d/x", "1")], "path string, text string")
        readers.bilingual(left, left.where("false"))


def test_pathfinder(spark):
    d = np.array([[0, 0.1, 0.5], [0.1, 0, 0.2], [0.5, 0.2, 0]])
    assert [x[:2] for x in analysis.pathfinder_full(list("abc"), d)] == [("a", "b"), ("b", "c")]
    edges = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.5), ("b", "c", 0.2)], "a string, b string, distance double")
    assert sorted((r.a, r.b) for r in analysis.pathfinder(edges).collect()) == [("a", "b"), ("b", "c")]


def test_clusters_and_decomposition(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 30))
    coo = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(40) for j in range(30)], "object long, column long, val double")
    left = np.zeros((40, 3))
    for r in analysis.decomposition(coo, 3, rounds=2, extra=3).collect():
        left[r.object, r.component] = r.val
    u = np.linalg.svd(m)[0][:, :3]
    assert np.allclose(np.abs(np.diag(u.T @ left)), 1, atol=1e-3)
    store = spark.createDataFrame([(i, [1.0, 0.01 * i, 0.0] if i % 2 else [0.0, 0.01 * i, 1.0]) for i in range(20)], "object long, vec array<double>")
    groups = {r.object: r.cluster for r in analysis.k_means(store, 2).collect()}
    assert len({groups[i] for i in range(1, 20, 2)}) == 1


def test_skip_gram_brings_companions_together(spark):
    rows = [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")] * 200
    pairs = spark.createDataFrame(rows, "term string, other string")
    vocabulary = spark.createDataFrame([(t, 200) for t in "abcdxy"], "term string, gf long")
    v = {r.object: np.array(r.vec) for r in trainers.skip_gram(pairs, vocabulary, 8, 20, 3, 0.5, 32).collect()}
    cos = lambda p, q: v[p] @ v[q] / np.linalg.norm(v[p]) / np.linalg.norm(v[q])
    assert cos("a", "b") > cos("a", "c") and cos("c", "d") > cos("b", "d")


def test_unknown_and_repeated_terms(spark):
    s = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 1.0, 0.0]), (4, [0.0, 0.2, 1.0]), (4, [0.0, 0.2, 1.0])], "object long, vec array<double>")
    first = lambda df: [(r.object, r.score) for r in df.collect()]
    assert dict(first(search.search_sum(s, [1, 1, 2])))[3] == pytest.approx(3 / math.sqrt(10), abs=1e-6)
    assert first(search.search_sum(s, [1, 99])) == first(search.search_sum(s, [1])) and not first(search.search_sum(s, [98, 99]))
    assert first(search.search_not(s, [1], [99])) == first(search.search_sum(s, [1])) and not first(search.search_not(s, [99], [1]))
    assert first(search.search_subspace(s, [1, 99, 1])) == first(search.search_subspace(s, [1]))
    assert first(search.search_extreme(s, [1, 99], True)) == first(search.search_extreme(s, [1], True))
    assert not first(search.search_bound(s, 99, 1)) and not first(search.search_bound(s, 1, 99)) and first(search.search_bound(s, 1, 1))
    assert [o for o, _ in first(search.search_analogy(s, 99, 1, 2))][0] == 3 and first(search.search_analogy(s, 1, 2, 1))
    assert first(search.search_permuted(s, [99, None, 2])) == first(search.search_permuted(s, [None, 2]))
    assert first(search.search_proximity(s, [1, 99, 2], (3, 4))) == first(search.search_proximity(s, [1, 2], (3, 4))) and not first(search.search_proximity(s, [1, 2], (3, 99)))
    assert not first(search.search_bound_subspace(s, 99, [1])) and not first(search.search_balanced(s, s, 99)) and not first(search.search_bound_minimum(s, [98, 99]))
    assert first(search.search_bound_minimum(s, [1, 99]))[0][1] == 0
    weights = spark.createDataFrame([(1, 3.0), (2, 0.0)], "term long, weight double")
    assert first(search.search_sum(s, [1, 2], weights=weights)) == first(search.search_sum(s, [1]))


def test_query_language(spark):
    parts = expressions.parsed("S(new york~NOT city)*P(x) + E(a)|S(b)")
    assert parts == [[[expressions.Atom("S", "new york", ("city",)), expressions.Atom("P", "x")], [expressions.Atom("E", "a")]], [[expressions.Atom("S", "b")]]]
    for bad in ("", "S()", "X(a)", "S(a)**S(b)", "S(a"):
        with pytest.raises(ValueError):
            expressions.parsed(bad)
    space = models.Space(64, 4)
    names = spark.createDataFrame([(t,) for t in ("peru", "chile", "lima")], "object string")
    store = names.select("object", models.elemental_vector(F.col("object"), space).alias("vec"))
    spaces = expressions.Spaces(store, space)
    assert expressions.found(spaces, "E(peru)").first() == ("peru", 1.0)
    assert expressions.found(spaces, "S(nowhere)").count() == 0 == expressions.found(spaces, "S(nowhere)*S(peru)").count()
    assert expressions.compared(spaces, "S(peru)+S(nowhere)", "E(peru)").first().score == 1 and expressions.compared(spaces, "S(nowhere)", "E(peru)").first().score == 0


def test_permutations(spark):
    p = F.array(*map(F.lit, (2, 0, 1, 3)))
    assert value(spark, V.scattered(vec(5, 6, 7, 8), p)) == [6, 7, 5, 8] and value(spark, V.inverse(p)) == [1, 2, 0, 3]
    named = value(spark, V.permutation(F.lit("x"), 40))
    assert sorted(named) == list(range(40)) != named
    near = value(spark, V.swapped(F.array(*map(F.lit, named)), F.lit("y")))
    assert sorted(near) == list(range(40)) and sum(a != b for a, b in zip(named, near)) == 10


def test_ground_fields(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=32), rng.normal(size=32)
    x, y = a[::2] + 1j * a[1::2], b[::2] + 1j * b[1::2]
    flat = lambda z: np.stack([z.real, z.imag], 1).ravel() / np.linalg.norm(z)
    assert np.allclose(value(spark, G.hermitian_bind(vec(*a), vec(*b))), flat(x * y))
    assert np.allclose(value(spark, G.hermitian_release(vec(*a), vec(*b))), flat(x * y.conj()))
    rest = y - (x.conj() @ y) / (x.conj() @ x) * x
    assert np.allclose(value(spark, G.orthogonalised("complex", vec(*a), vec(*b))), flat(rest))
    bits, more = (vec(*(v > 0).astype(float)) for v in (a, b))
    assert value(spark, G.bit_overlap(bits, G.orthogonalised("binary", bits, more))) == 0
    assert sum(value(spark, G.elemental_bits(F.lit("k"), 32))) == 16
    assert value(spark, G.majority(G.votes([(vec(1, 1, 0, 0), 1.0), (vec(1, 0, 1, 0), 1.0)]))) == [1, 0, 1, 0]
    for kind, field in G.FIELDS.items():
        u, v = (bits, more) if kind == "binary" else (vec(*a), vec(*b))
        assert value(spark, field.overlap(u, u)) == pytest.approx(1), kind
        assert value(spark, field.overlap(field.release(field.bind(u, v), v), u)) > 0.4, kind


def test_hops_and_coordinates(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5)], "a long, b long")
    got = {(r.a, r.b): r.hops for r in analysis.hops(links, 3).collect()}
    assert got == {(1, 2): 1, (2, 3): 1, (3, 4): 1, (1, 5): 1, (1, 3): 2, (2, 4): 2, (2, 5): 2, (1, 4): 3, (3, 5): 3}
    m = np.random.default_rng(6).normal(size=(50, 4)) * [5, 2, 1, 0.1]
    store = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "object long, vec array<double>")
    at = np.array([r["at"] for r in analysis.principal_components(store).orderBy("object").collect()])
    c = m - m.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(at), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_predication_embeddings_share_arguments(spark):
    rows = [(f"s{i}", "LIKES" if i % 2 else "HATES", f"o{i % 4 // 2}") for i in range(40)] * 20
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string")
    v = {r.object: np.array(r.vec) for r in trainers.predication_embeddings(triples, 24, 12, 3, 0.5, 64).collect()}
    cos = lambda p, q: v[p] @ v[q] / np.linalg.norm(v[p]) / np.linalg.norm(v[q])
    assert np.mean([cos("s1", f"s{i}") for i in range(5, 40, 4)]) > 0.6 > np.mean([cos("s1", f"s{i}") for i in range(3, 40, 4)]) + 0.2


def test_bound_step_follows_the_slope():
    rng = np.random.default_rng(1)
    s, e, p = (rng.normal(0, 0.3, size=(2, 8)) for _ in range(3))
    loss = lambda: -np.log(1 / (1 + np.exp(-(s[0] * trainers._convolved(p[:1], e[1:])[0]).sum())))
    before = [x.copy() for x in (s, e, p)]
    base = loss()
    for x in (s, e, p):
        slope = np.zeros_like(x)
        for at in np.ndindex(x.shape):
            x[at] += 1e-6
            slope[at] = (loss() - base) / 1e-6
            x[at] -= 1e-6
        own = [y.copy() for y in before]
        trainers.bound_step(*own, np.array([0]), np.array([1]), np.array([0]), np.array([1.0]), 0.1)
        k = next(i for i, y in enumerate((s, e, p)) if y is x)
        assert np.allclose(own[k] - before[k], -0.1 * slope, atol=1e-4)


@pytest.mark.parametrize("name", ["postings", "ri_term_vectors", "ri_binary_term_vectors", "positional_directional", "vector_bind", "phase_release", "search_not", "search_keyword", "predication_vectors", "pathfinder", "permutation_swapped", "expression_product", "window_exact", "nearest_predicate"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    keys = sorted(got.columns)
    sort = lambda p: p[keys].sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(got), sort(want), check_dtype=False)


def test_stream_grows_the_model_of_all_documents(spark, tmp_path):
    space = models.Space(32, 4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    docs.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        incremental.train(stream, str(tmp_path / "model"), str(tmp_path / "checkpoint"), space).awaitTermination()
    whole = spark.read.parquet(str(tmp_path / "in"))
    want = {(r.object, r.dim): r.val for r in incremental.batch_sums(whole, space).collect()}
    got = {(r.object, r.dim): r.val for r in incremental.sums(spark, str(tmp_path / "model")).collect()}
    assert got == want and len(list((tmp_path / "model").glob("batch=*"))) == 3
    assert incremental.sums(spark, str(tmp_path / "none")).count() == 0


def test_running_sums_over_ranges(spark):
    rows = [(i, float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r.s for r in analysis.running(df, "k", F.col("v"), "s").collect()}
    assert got == dict(zip(range(500), np.cumsum([v for _, v in rows])))
    ranks = {r.k: r.r for r in analysis.average_rank(df, "v", "r").collect()}
    assert ranks == dict(enumerate(pd.Series([v for _, v in rows]).rank()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_k_means_runs_until_nothing_moves(spark):
    angles = np.random.default_rng(2).random(1500) * np.pi / 2
    units = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    rows = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(units)], "object long, vec array<double>")

    def moved(found):
        at = np.array([r.cluster for r in sorted(found.collect())])
        centres = np.stack([units[at == c].sum(axis=0) for c in range(10)])
        return int(((units @ (centres / np.linalg.norm(centres, axis=1, keepdims=True)).T).argmax(axis=1) != at).sum())

    assert moved(analysis.k_means(rows)) == 0 < moved(analysis.k_means(rows, rounds=20))


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest imports with both folders of the corpus operators gone, with and without the pipeline's file."""
    here = Path(__file__).parent.parent
    for name in ("__spark_entry__.py", "wordloom", "corpus_pipeline.py"):
        if not (here / name).exists():  # it may be gone already
            continue
        (shutil.copytree if (here / name).is_dir() else shutil.copy)(here / name, tmp_path / name)
    shutil.rmtree(tmp_path / "wordloom" / "llm", ignore_errors=True)
    said = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", said], cwd=tmp_path, check=True)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", said], cwd=tmp_path, check=True)


def _numbered(spark, docs, space):
    counted = slabs.counts(docs)
    n = docs.count()
    return slabs.vocabulary(corpus.filtered(counted, 2, min_length=2), F.log10(F.lit(n) / F.col("df")), models.places(F.col("term"), space))


@pytest.fixture
def few_docs(spark):
    rng = np.random.default_rng(5)
    words = ["aa", "bb", "cc", "dd", "x", *(f"w{chr(97 + i)}" for i in range(20))]
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(30)]
    return spark.createDataFrame([*texts, (98, None), (99, ""), (97, "aa aa")], "doc_id long, text string")


@pytest.mark.parametrize("how", [{}, {"exact": True}, {"random": True}])
def test_windows_are_counted_in_packed_slabs(spark, few_docs, how, monkeypatch):
    monkeypatch.setattr(slabs, "KEYS", 50)
    tf, vocabulary = models.corpus_space(few_docs, 2)
    want = corpus.window_pairs(corpus.tokens(few_docs), vocabulary, 3, **how).groupBy("term", "other", "offset").agg(F.count("*").alias("n"))
    got = slabs.window_counts(few_docs, _numbered(spark, few_docs, models.Space(16, 4)), 3, **how)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("method", ["basic", "directional", "permutation", "permutation_plus_basic", "proximity"])
def test_positional_sums_of_packed_slabs(spark, few_docs, method, monkeypatch):
    monkeypatch.setattr(slabs, "KEYS", 50)
    space = models.Space(16, 4)
    tf, vocabulary = models.corpus_space(few_docs, 2)
    weights = vocabulary.select("term", F.log10(F.lit(few_docs.count()) / F.col("df")).alias("weight"))
    want = models.normalised(models.positional(corpus.window_pairs(corpus.tokens(few_docs), vocabulary, 2), weights, space, method))
    got = slabs.positional(few_docs, _numbered(spark, few_docs, space), 16, 2, models.moves(spark, 2, space, method))
    x, y = ({(r.object, r.dim): r.val for r in df.collect()} for df in (got, want))
    assert x.keys() == y.keys() and all(x[k] == pytest.approx(y[k], abs=1e-9) for k in x)


def test_packed_keys_come_back():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 49, 1000))
    assert (np.cumsum(slabs.unpacked(slabs.packed(np.diff(keys, prepend=0)), 1000)) == keys).all() and len(slabs.unpacked(slabs.packed(keys[:0]), 0)) == 0


def test_row_vectors_by_batch(spark, monkeypatch):
    monkeypatch.setattr(rows, "PART_ROWS", 2)
    space = models.Space(16, 4)
    data = [(1, "a", "x", 1, 2.0), (2, "b", None, 3, 4.0), (3, None, "x", 2, None), (4, None, None, 5, 9.0), (5, "a", "y", 4, 3.5)]
    df = spark.createDataFrame(data, "k long, s string, t string, n int, m double")
    for x in (df, df.withColumn("k", F.col("k") % 3)):
        want = models.normalised(models.table_rows(x, "k", ["s", "t"], ["n", "m"], space))
        got = rows.vectors(x, "k", ["s", "t"], ["n", "m"], space)
        a, b = ({(r.object, r.dim): r.val for r in y.collect()} for y in (got, want))
        assert a.keys() == b.keys() and all(a[k] is b[k] or a[k] == pytest.approx(b[k], abs=1e-9) for k in b)
        q = {r.dim: r.val for r in want.collect() if r.object == "1"}
        hits = {r.object: r.x for r in rows.scores(x, "k", ["s", "t"], ["n", "m"], space, q).collect()}
        assert hits == pytest.approx({o: sum(v * q[d] for (p, d), v in b.items() if p == o and d in q and v is not None) for o in hits})
    assert rows.spread(df).rdd.getNumPartitions() == 3


def test_dense_elemental_store_of_numbers(spark, few_docs):
    space = models.Space(16, 4)
    held = _numbered(spark, few_docs, space)
    got = {(r.object, r.i): r.val for r in slabs.elemental(spark, held, 16).collect()}
    want = spark.createDataFrame([(w,) for w in held.words.to_pylist()], "term string").select("term", models.elemental_vector(F.col("term"), space).alias("v")).collect()
    assert got == {(r.term, i): x for r in want for i, x in enumerate(r.v)}
