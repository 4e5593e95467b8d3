"""Query vectors and searchers over a store (object, vec).

A query vector is a table of one row, made from the store's own rows; it is crossed
with the store, every row is scored by a column expression, and the best are taken
without a full sort. Ties go by object.

Terms are looked up in the order of the query, a repeated term counts each time. A
term that the store lacks is left out of sums and subspaces; where a term has a place
of its own (an analogy, a bound pair, a pattern) it stands as a zero vector. A query
that comes to nothing finds nothing. Of store rows that share an object the
least vector counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources.shared import written
from . import analysis


def looked_up(store: DataFrame, terms: list) -> DataFrame:
    """One row: m, the vectors of those terms that the store has, by term; without any there is no row."""
    named = sorted({t for t in terms if t is not None}, key=str)
    found = store.where(F.col("object").isin(named)).groupBy("object").agg(F.min("vec").alias("vec"))
    return found.agg(F.map_from_entries(F.collect_list(F.struct("object", "vec"))).alias("m")).where(F.size("m") > 0)


def at(term) -> Column:
    """A term's vector in looked_up(); null if there is none."""
    return F.try_element_at("m", F.lit(term))


def or_zero(term) -> Column:
    return F.coalesce(at(term), F.transform(F.element_at(F.map_values("m"), 1), lambda x: x * F.lit(0.0)))


def gathered(store: DataFrame, terms: list) -> DataFrame:
    """One row: vs, the vectors of the terms in their order, repeats included; missing terms are left out, and without any there is no row."""
    vs = F.filter(F.array(*(at(t) for t in terms)), lambda v: v.isNotNull())
    return looked_up(store, terms).select(vs.alias("vs")).where(F.size("vs") > 0)


def placed(store: DataFrame, terms: list) -> DataFrame:
    """One row: vs, a vector for each term, zero for a missing one; without any there is no row."""
    return looked_up(store, terms).select(F.array(*(or_zero(t) for t in terms)).alias("vs"))


def total(vs: Column) -> Column:
    """The normalised sum of the vectors."""
    return V.normalise(F.aggregate(F.slice(vs, 2, F.size(vs)), F.get(vs, F.lit(0)), lambda s, v: V.superpose(s, v)))


def additive(store: DataFrame, terms: list, weights: DataFrame | None = None) -> DataFrame:
    """One row: q, the normalised sum of the terms' vectors, each times its weight (term, weight) if there are weights; a term without one has none."""
    if weights is None:
        return gathered(store, terms).select(total(F.col("vs")).alias("q"))
    w = weights.where(F.col("term").isin(list(terms))).select(F.col("term").alias("object"), "weight")
    weighted = store.join(F.broadcast(w), "object").select("object", V.scale(F.col("vec"), F.col("weight")).alias("vec"))
    return gathered(weighted, terms).select(total(F.col("vs")).alias("q"))


def matching(store: DataFrame, pattern: str) -> DataFrame:
    """One row: q, the normalised sum of all vectors whose object the pattern finds; summed place by place, so that many may match."""
    long = store.where(F.col("object").cast("string").rlike(pattern)).select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    vec = long.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    return vec.where(F.size("v") > 0).select(V.normalise(F.col("v")).alias("q"))


def orthonormal(vs: Column) -> Column:
    """Gram-Schmidt over an array of vectors in their order; what the others span is dropped."""
    def add(basis: Column, v: Column) -> Column:
        rest = F.aggregate(basis, V.normalise(v), lambda x, u: V.superpose(x, u, -V.dot(x, u)))
        return V.let(rest, lambda r: F.when(V.norm(r) > 1e-9, F.concat(basis, F.array(V.normalise(r)))).otherwise(basis))

    return F.aggregate(vs, F.array().cast("array<array<double>>"), add)


def projected(vec: Column, basis: Column) -> Column:
    """The length of a vector's projection on an orthonormal basis."""
    return V.let(V.normalise(vec), lambda u: F.sqrt(F.aggregate(F.transform(basis, lambda b: F.pow(V.dot(u, b), 2)), F.lit(0.0), lambda s, x: s + x)))


def scored(store: DataFrame, query: DataFrame, score: Column) -> DataFrame:
    """(object, score) of every row; query is one row."""
    return store.crossJoin(F.broadcast(query)).select("object", F.round(score, 6).alias("score"))


def near(store: DataFrame, query: DataFrame) -> DataFrame:
    """(object, score): the cosine of every row and the query's q; a zero query finds nothing."""
    return scored(store, query.where(~V.is_zero(F.col("q"))), V.cosine(F.col("vec"), F.col("q")))


def best(hits: DataFrame, k: int = 20, least: float = -1.0) -> DataFrame:
    return hits.where(F.col("score") > least).orderBy(F.desc("score"), "object").limit(k)


def above(hits: DataFrame, least: float) -> DataFrame:
    """All hits above a score, best first."""
    return hits.where(F.col("score") > least).orderBy(F.desc("score"), "object")


def weighted(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores times the objects' weights (term, weight); an object without one scores nothing."""
    w = weights.select(F.col("term").alias("object"), "weight")
    return hits.join(w, "object", "left").select("object", F.round(F.col("score") * F.coalesce("weight", F.lit(0.0)), 6).alias("score"))


def vectors_of(hits: DataFrame, store: DataFrame) -> DataFrame:
    """The hits with their vectors; hits are few."""
    return store.join(F.broadcast(hits), "object")


def search_sum(store: DataFrame, terms: list, k: int = 20, weights: DataFrame | None = None) -> DataFrame:
    return best(near(store, additive(store, terms, weights)), k)


def search_matching(store: DataFrame, pattern: str, k: int = 20) -> DataFrame:
    return best(near(store, matching(store, pattern)), k)


def search_not(store: DataFrame, positive: list, negative: list, k: int = 20, suppress: bool = False) -> DataFrame:
    """What is near the sum of the positive terms and orthogonal to every negative one; suppress takes the negative ones as any others."""
    if suppress:
        return search_sum(store, [*positive, *negative], k)
    vs = lambda terms: F.filter(F.array(*(at(t) for t in terms)), lambda v: v.isNotNull())
    both = looked_up(store, [*positive, *negative]).select(vs(positive).alias("ps"), vs(negative).alias("ns") if negative else F.array().cast("array<array<double>>").alias("ns")).where(F.size("ps") > 0)
    q = F.aggregate(orthonormal(F.col("ns")), total(F.col("ps")), lambda x, u: V.superpose(x, u, -V.dot(x, u)))
    return best(near(store, both.select(V.normalise(q).alias("q"))), k)


def search_subspace(store: DataFrame, terms: list, k: int = 20) -> DataFrame:
    """The length of a row's projection on the span of the terms."""
    basis = gathered(store, terms).select(orthonormal(F.col("vs")).alias("basis"))
    return best(scored(store, basis.where(F.size("basis") > 0), projected(F.col("vec"), F.col("basis"))), k)


def search_extreme(store: DataFrame, terms: list, least: bool, k: int = 20) -> DataFrame:
    """The greatest or least of the cosines with the terms; a term may be a list of terms that are summed."""
    parts = [t if isinstance(t, list) else [t] for t in terms]
    vs = F.filter(F.array(*(F.filter(F.array(*(at(t) for t in part)), lambda v: v.isNotNull()) for part in parts)), lambda x: F.size(x) > 0)
    query = looked_up(store, [t for part in parts for t in part]).select(F.transform(vs, total).alias("vs"))
    scores = F.transform("vs", lambda v: V.cosine(F.col("vec"), v))
    return best(scored(store, query, F.array_min(scores) if least else F.array_max(scores)), k)


def search_permuted(store: DataFrame, pattern: list, k: int = 20) -> DataFrame:
    """pattern holds one None: each other term is shifted by its distance from it."""
    gap = pattern.index(None)
    turned = F.filter(F.array(*(V.shift(at(t), i - gap) for i, t in enumerate(pattern) if t is not None)), lambda v: v.isNotNull())
    q = looked_up(store, pattern).select(turned.alias("vs")).where(F.size("vs") > 0).select(total(F.col("vs")).alias("q"))
    return best(near(store, q), k)


def search_turned(store: DataFrame, term, permutations: list[Column], k: int = 20) -> DataFrame:
    """The term's vector after permutations, one after another (arrays: coordinate i goes to place p[i])."""
    q = at(term)
    for p in permutations:
        q = V.scattered(q, p)
    return best(near(store, looked_up(store, [term]).select(q.alias("q"))), k)


def search_analogy(store: DataFrame, a, b, c, k: int = 20) -> DataFrame:
    """a is to b as c is to the hits."""
    one = lambda i: V.normalise(F.get("vs", F.lit(i)))
    q = placed(store, [a, b, c]).select(V.superpose(V.superpose(one(1), one(0), -1.0), one(2)).alias("q"))
    return best(near(store.where(~F.col("object").isin([a, b, c])), q), k)


def search_bound(store: DataFrame, first, second, k: int = 20, method: str = "normalized") -> DataFrame:
    """Rows near first released from second; nothing if either is missing."""
    known = (F.get("vs", F.lit(0)), F.get("vs", F.lit(1)))
    q = placed(store, [first, second]).where(~V.is_zero(known[0]) & ~V.is_zero(known[1])).select(V.release(*known, method).alias("q"))
    return best(near(store, q), k)


def search_bound_subspace(store: DataFrame, first, seconds: list, k: int = 20, method: str = "plain") -> DataFrame:
    """The projection on the span of first released from each of the seconds that there are."""
    vs = F.filter(F.array(*(at(t) for t in seconds)), lambda v: v.isNotNull())
    q = looked_up(store, [first, *seconds]).where(at(first).isNotNull()).select(orthonormal(F.transform(vs, lambda v: V.release(at(first), v, method))).alias("basis"))
    return best(scored(store, q.where(F.size("basis") > 0), projected(F.col("vec"), F.col("basis"))), k)


def search_bound_minimum(store: DataFrame, terms: list, k: int = 20) -> DataFrame:
    """The greatest of the lesser scores of consecutive pairs, 0 at least."""
    s = [V.cosine(F.col("vec"), F.get("vs", F.lit(i))) for i in range(len(terms))]
    pairs = [F.least(*s[i : i + 2]) if i + 1 < len(s) else s[i] for i in range(0, len(s), 2)]
    return best(scored(store, placed(store, terms), F.greatest(F.lit(0.0), F.lit(0.0), *pairs)), k)


def search_balanced(store: DataFrame, other: DataFrame, term, by: int = 1, k: int = 20) -> DataFrame:
    """The better of two directions over two stores joined by object."""
    q = gathered(store, [term]).select(F.get("vs", F.lit(0)).alias("q"))
    both = store.join(other.withColumnRenamed("vec", "vec2"), "object")
    return best(both.crossJoin(F.broadcast(q)).select("object", F.round(F.greatest(V.cosine(F.col("vec"), V.shift(F.col("q"), by)), V.cosine(F.col("vec2"), V.shift(F.col("q"), -by))), 6).alias("score")), k)


def search_proximity(store: DataFrame, terms: list, ends: tuple, k: int = 20) -> DataFrame:
    """Sum over adjacent terms of the distance of a row's two overlaps when released by each; missing terms are left out, without both ends nothing is found."""
    vs = F.filter(F.array(*(at(t) for t in terms)), lambda v: v.isNotNull())
    q = looked_up(store, [*terms, *ends]).select(vs.alias("vs"), at(ends[0]).alias("low"), at(ends[1]).alias("high")).where("low is not null and high is not null and size(vs) > 0")
    freed = lambda v: V.release(F.col("vec"), v, "permutation")
    places = F.transform("vs", lambda v: V.let(freed(v), lambda r: F.struct(V.cosine(r, F.col("low")).alias("x"), V.cosine(r, F.col("high")).alias("y"))))
    apart = lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))
    steps = V.let(places, lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), apart))
    return best(scored(store, q, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)), k)


def expanded(store: DataFrame, pairs: DataFrame, method: str = "plain") -> DataFrame:
    """The store and, for each pair (x, y) of its objects, x released by y under the name y:x. Which pairs there are is the caller's to bound."""
    x, y = (store.select(F.col("object").alias(c), F.col("vec").alias(f"v{c}")) for c in "xy")
    new = pairs.join(x, "x").join(y, "y").select(F.concat_ws(":", F.col("y").cast("string"), F.col("x").cast("string")).alias("object"), V.release(F.col("vx"), F.col("vy"), method).alias("vec"))
    return store.select(F.col("object").cast("string").alias("object"), "vec").unionByName(new)


def union_sum(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two stores as one: vectors of equal objects are added."""
    both = one.withColumnRenamed("vec", "a").join(two.withColumnRenamed("vec", "b"), "object", "full")
    return both.select("object", F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(V.superpose(F.col("a"), F.col("b"))).alias("vec"))


def nearest(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item, object, score): of few candidates (object, vec) the one nearest to each item (item, q); the first of equal ones."""
    s = items.crossJoin(F.broadcast(candidates)).select("item", "object", F.round(V.cosine(F.col("q"), F.col("vec")), 6).alias("score"))
    top = s.groupBy("item").agg(F.max(F.col("score")).alias("score"))
    return s.join(top, ["item", "score"]).groupBy("item", "score").agg(F.min("object").alias("object")).select("item", "object", "score")


def standardised(hits: DataFrame) -> DataFrame:
    stats = hits.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return hits.crossJoin(F.broadcast(stats)).select("object", F.round((F.col("score") - F.col("m")) / F.col("s"), 6).alias("score"))


#: Rows of one side in a block of batch().
BLOCK_ROWS = 1024
#: A score in single precision is no further than this off the rounded one.
NEAR = 1e-5


def _true(m: np.ndarray) -> np.ndarray:
    """Flat places of the few that are true: eight at once."""
    flat = m.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return at[flat[at]]


def _bettered(top: np.ndarray, who: np.ndarray, ids: np.ndarray, q: np.ndarray, objects: np.ndarray, u: np.ndarray) -> None:
    """Brings the best scores and objects of each query so far, best first, up to date with a block of unit vectors.

    Scores come in single precision; only what is near a query's best, or among them, is
    worked out again in double precision, rounded and sorted.
    """
    k = top.shape[1]
    s = q.astype(np.float32) @ u.astype(np.float32).T
    least = top[:, -1].copy()
    new = np.isneginf(least)
    if new.any() and s.shape[1] > k:  # one of them may be the query itself
        least[new] = np.partition(s[new], -k - 1, axis=1)[:, -k - 1]
    x, y = np.divmod(_true(s >= (least - NEAR).astype(np.float32)[:, None]), s.shape[1])
    other = ids[x] != objects[y]
    x, y = x[other], y[other]
    if not len(x):
        return
    rows = np.unique(x)
    at = np.r_[np.repeat(rows, k), x]
    score = np.r_[top[rows].ravel(), np.round(np.einsum("ij,ij->i", q[x], u[y]), 6)]
    name = np.r_[who[rows].ravel(), objects[y]]
    order = np.lexsort((name, -score, at))
    keep = order[np.searchsorted(at[order], rows)[:, None] + np.arange(k)]
    top[rows], who[rows] = score[keep], name[keep]


def batch(store: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, object, score, rank): the k best of each query (query, q) but the query itself.

    Both sides are packed in blocks of a bounded number of unit vectors, and each block of
    queries meets every block of the store. A task keeps k hits a query, so that what is
    shuffled is bounded by queries times parts of the store, not by pairs.
    """
    queries = analysis.packed_units(queries.select(F.col("query").alias("object"), F.col("q").alias("vec")), BLOCK_ROWS)
    units = analysis.packed_units(store, BLOCK_ROWS)

    def score(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch_ in batches:
            for i in range(len(batch_)):
                block, objects, u = batch_.column(0)[i].as_py(), *_opened(batch_, i, 3)
                if block not in held:
                    ids, q = _opened(batch_, i, 1)
                    held[block] = [np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64), ids, q]
                _bettered(*held[block], objects, u)
        for top, who, ids, _ in held.values():
            there = np.isfinite(top)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.broadcast_to(ids[:, None], top.shape)[there], who[there], top[there])], names=["query", "object", "score"])

    parts = max(1, min(queries.count(), 4 * store.sparkSession.sparkContext.defaultParallelism))
    left = queries.repartition(parts).select(F.monotonically_increasing_id().alias("block"), F.col("objects").alias("ids"), F.col("units").alias("qs"))
    # a stated set of queries against all rows, block by block; Spark sends at most 64 MB of them to a worker at once
    hits = left.crossJoin(units).mapInArrow(score, "query long, object long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "object"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _opened(batch_: pa.RecordBatch, i: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """(objects, units) of row i, in columns c and c + 1."""
    objects = batch_.column(c)[i].values.to_numpy()
    return objects, np.frombuffer(batch_.column(c + 1)[i].as_py(), np.float64).reshape(len(objects), -1)


def compare(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, score) of each pair (a, b); 0 where a vector is missing."""
    x = pairs.join(store.select(F.col("object").alias("a"), F.col("vec").alias("va")), "a", "left").join(store.select(F.col("object").alias("b"), F.col("vec").alias("vb")), "b", "left")
    return x.select("a", "b", F.coalesce(F.round(V.cosine(F.col("va"), F.col("vb")), 6), F.lit(0.0)).alias("score"))


def keyword_in(docs: DataFrame, terms: list[str], k: int = 20, k1: float = 1.2, b: float = 0.75, allowed: DataFrame | None = None) -> DataFrame:
    """keyword() over documents: a document gives one row with its length and how often it has each term; no other postings are made."""
    terms = list(dict.fromkeys(terms))
    words = docs.select("doc_id", T.words(F.col("text")).alias("words")).where(F.size("words") > 0)
    own = [F.size(F.filter("words", F.lit(t).__eq__)).cast("long").alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = words.select("doc_id", F.size("words").cast("long").alias("length"), *own)
    rows = written(rows.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in rows.columns[1:])), "lengths")
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hits = rows.where(F.greatest(F.lit(0), *(F.col(f"tf{i}") for i in range(len(terms)))) > 0).where("doc_id is not null")
    if allowed is not None:
        hits = hits.join(allowed, "doc_id", "left_semi")
    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        return F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))

    score = sum((part(i) for i in range(len(terms))), F.lit(0.0))
    return best(hits.crossJoin(F.broadcast(stats)).select(F.col("doc_id").alias("object"), F.round(score, 6).alias("score")), k, 0.0)


def keyword(tf: DataFrame, terms: list[str], k: int = 20, k1: float = 1.2, b: float = 0.75, allowed: DataFrame | None = None) -> DataFrame:
    """BM25 over the postings; only the allowed documents (doc_id) are hits, statistics are those of all."""
    lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = tf.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    if allowed is not None:
        hits = hits.join(allowed, "doc_id", "left_semi")
    x = hits.join(F.broadcast(df), "term").join(lengths, "doc_id").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return best(x.groupBy(F.col("doc_id").alias("object")).agg(F.round(F.sum(part), 6).alias("score")), k, 0.0)
