"""Registered queries of the ground fields: complex and binary vectors, permutations, orthogonalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fields as G
from ..functions import vectors as V
from . import sql as S
from .registry import ORACLES, QUERIES, entries, pairs_of_store, query, rounded, store

W = S.WIDTH
#: Each row of the store beside the next one.
P = f"WITH {S.STORE}, p AS (SELECT x.object, x.vec AS a, y.vec AS b FROM s x JOIN s y ON y.object = x.object + 1)"
_range = f"range({W}) r(i)"


def _over_pairs(name: str, vec: Callable[[Column, Column], Column], value: str, ctes: str = "", source: str = "p", places: str = _range) -> None:
    """A query that makes a vector of each pair, in long form; value is its i-th coordinate in SQL."""
    ORACLES[name] = f"{P}{ctes} SELECT object, CAST(i AS INTEGER) AS i, round(CAST({value} AS DOUBLE), 6) + 0.0 AS val FROM {source}, {places}"
    QUERIES[name] = lambda spark, d: entries(pairs_of_store(spark, d), vec(F.col("a"), F.col("b")))


# complex vectors: phases

_turn = "2 * pi() / 16384"
_angle = lambda x, y: f"(CASE WHEN atan2({y}, {x}) < 0 THEN atan2({y}, {x}) + 2 * pi() ELSE atan2({y}, {x}) END)"
_phase = lambda v: f"list_transform(range({W} // 2), lambda i: CAST(floor({_angle(f'{v}[2 * i + 1]', f'{v}[2 * i + 2]')} / ({_turn})) AS INTEGER) % 16384)"
PH = f", ph AS (SELECT object, {_phase('a')} AS a, {_phase('b')} AS b FROM p)"
_part = lambda v, w="": f"(CASE WHEN i % 2 = 0 THEN cos({_turn} * {v}[i // 2 + 1]) ELSE sin({_turn} * {v}[i // 2 + 1]) END){w}"
_ph = lambda f: lambda a, b: f(V.phases(a), V.phases(b))
_over_pairs("phase_cartesian", _ph(lambda a, b: V.cartesian(a)), _part("a"), PH, "ph")
_over_pairs("phase_superpose", _ph(lambda a, b: G.phase_superpose(a, b, 0.5)), f"{_part('a')} + 0.5 * {_part('b')}", PH, "ph")
_over_pairs("phase_normalise", lambda a, b: G.unit_circle(V.superpose(a, b, 0.5)), "(CASE WHEN i % 2 = 0 THEN a[i + 1] + 0.5 * b[i + 1] ELSE a[i + 1] + 0.5 * b[i + 1] END) / sqrt(pow(a[i - i % 2 + 1] + 0.5 * b[i - i % 2 + 1], 2) + pow(a[i - i % 2 + 2] + 0.5 * b[i - i % 2 + 2], 2))")
_over_pairs("hermitian_bind", G.hermitian_bind, "CASE WHEN i % 2 = 0 THEN a[i + 1] * b[i + 1] - a[i + 2] * b[i + 2] ELSE a[i] * b[i + 1] + a[i + 1] * b[i] END / len", f", q AS (SELECT *, sqrt(list_sum(list_transform(range({W} // 2), lambda j: (pow(a[2 * j + 1], 2) + pow(a[2 * j + 2], 2)) * (pow(b[2 * j + 1], 2) + pow(b[2 * j + 2], 2))))) AS len FROM p)", "q")
_over_pairs("hermitian_release", G.hermitian_release, "CASE WHEN i % 2 = 0 THEN a[i + 1] * b[i + 1] + a[i + 2] * b[i + 2] ELSE a[i + 1] * b[i] - a[i] * b[i + 1] END / len", f", q AS (SELECT *, sqrt(list_sum(list_transform(range({W} // 2), lambda j: (pow(a[2 * j + 1], 2) + pow(a[2 * j + 2], 2)) * (pow(b[2 * j + 1], 2) + pow(b[2 * j + 2], 2))))) AS len FROM p)", "q")


@query(f"""{P} SELECT object, round(list_avg(list_transform(range({W} // 2), lambda j: (a[2 * j + 1] * b[2 * j + 1] + a[2 * j + 2] * b[2 * j + 2]) / sqrt((pow(a[2 * j + 1], 2) + pow(a[2 * j + 2], 2)) * (pow(b[2 * j + 1], 2) + pow(b[2 * j + 2], 2))))), 6) + 0.0 AS cartesian, round(list_cosine_similarity(a, b), 6) + 0.0 AS hermitian FROM p""")
def complex_overlaps(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs_of_store(spark, d).select("object", rounded(G.cartesian_overlap(a, b)).alias("cartesian"), rounded(V.cosine(a, b)).alias("hermitian"))


# Hermitian Gram-Schmidt of a pair: b less its projection on a
_re, _im = (f"list_sum(list_transform(range({W} // 2), lambda j: {x}))" for x in ("b[2 * j + 1] * a[2 * j + 1] + b[2 * j + 2] * a[2 * j + 2]", "b[2 * j + 2] * a[2 * j + 1] - b[2 * j + 1] * a[2 * j + 2]"))
_GS = f""", g AS (SELECT object, a, b, {_re} / list_inner_product(a, a) AS re, {_im} / list_inner_product(a, a) AS im FROM p),
  h AS (SELECT object, list_transform(range({W}), lambda i: CASE WHEN i % 2 = 0 THEN b[i + 1] - (re * a[i + 1] - im * a[i + 2]) ELSE b[i + 1] - (re * a[i + 1] + im * a[i]) END) AS v FROM g)"""
_over_pairs("complex_orthogonal", G.hermitian_without, "v[i + 1] / sqrt(list_inner_product(v, v))", _GS, "h")


@query(f"""WITH {S.STORE}, drawn AS (SELECT object, i, row_number() OVER (PARTITION BY object ORDER BY md5(object || '#' || i)) AS r FROM s, {_range})
  SELECT object, CAST(i AS INTEGER) AS i, CAST({S.hashed("object || '@' || i")} % 16384 AS DOUBLE) AS val FROM drawn WHERE r <= {S.SEED}""")
def elemental_phases(spark, d):
    return entries(store(spark, d), G.elemental_phases(F.col("object").cast("string"), W, S.SEED)).where("val >= 0")


@query(f"WITH {S.STORE} SELECT object, CAST(i AS INTEGER) AS i, round(({S.hashed("object || '@' || i")} / 4294967296.0 - 0.5) / {W}, 6) + 0.0 AS val FROM s, {_range}")
def elemental_dense(spark, d):
    return entries(store(spark, d), G.elemental_dense(F.col("object").cast("string"), W))


# binary vectors


@query(f"WITH {S.STORE}, drawn AS (SELECT object, i, row_number() OVER (PARTITION BY object ORDER BY md5(object || '#' || i)) AS r FROM s, {_range}) SELECT object, CAST(i AS INTEGER) AS i, CASE WHEN r <= {W // 2} THEN 1.0 ELSE 0.0 END::DOUBLE AS val FROM drawn")
def elemental_binary(spark, d):
    return entries(store(spark, d), G.elemental_bits(F.col("object").cast("string"), W))


_bit = lambda v: f"({v}[i + 1] > 0)::INT"
_xor = f"(({_bit('a')}) <> ({_bit('b')}))::INT"
_bits = lambda f: lambda a, b: G.unpacked(f(V.bits(a), V.bits(b)), W)
_over_pairs("binary_bind", _bits(V.xor), _xor)
_over_pairs("binary_release", _bits(lambda a, b: V.xor(V.xor(a, b), b)), _bit("a"))
_over_pairs("binary_complement", _bits(lambda a, b: V.complement(a)), f"1 - {_bit('a')}")
_votes = lambda w: f", v AS (SELECT object, i, 100 * (2 * {_bit('a')} - 1) + {w} * (2 * {_bit('b')} - 1) AS n FROM p, {_range}), t AS (SELECT *, row_number() OVER (PARTITION BY object, n = 0 ORDER BY i) AS r FROM v)"
_vote = "CASE WHEN n > 0 THEN 1 WHEN n < 0 THEN 0 ELSE (r + 1) % 2 END"
_signs = lambda a: F.transform(a, lambda x: F.when(x > 0, 1.0).otherwise(0.0))
_over_pairs("binary_superpose", lambda a, b: G.majority(G.votes([(_signs(a), 1.0), (_signs(b), -1.0)])), _vote, _votes(-100), "t", "(SELECT 1)")
_over_pairs("binary_superpose_weighted", lambda a, b: G.majority(G.votes([(_signs(a), 1.0), (_signs(b), 0.5)])), _vote, _votes(50), "t", "(SELECT 1)")
_coin = lambda key: f"{S.hashed(key)} / 4294967296.0"
_over_pairs("binary_intersection", lambda a, b: G.intersection(_signs(a), _signs(b)), f"CASE WHEN {_xor} = 0 THEN {_bit('a')} WHEN {_coin("'23#' || i")} < 0.5 THEN 1 - {_bit('a')} ELSE {_bit('a')} END")
_over_pairs("binary_weighted_superposition", lambda a, b: G.weighted_bits(_signs(a), _signs(b), 3.0, 1.0), f"(({_coin("'weighted#' || i")}) < (3.0 * {_bit('a')} + {_bit('b')}) / 4.0)::INT")
_erf = "(1 - 1 / pow(1 + 0.278393 * x + 0.230389 * x * x + 0.000972 * pow(x, 3) + 0.078108 * pow(x, 4), 4))"
_over_pairs("binary_probabilistic", lambda a, b: G.probabilistic(G.votes([(_signs(a), 1.0), (_signs(b), 0.5)]), 150), f"({_coin("'normal#' || i")} < 0.5 * (1 + sign(z) * {_erf}))::INT", f", v AS (SELECT object, i, (50.0 * {_bit('a')} * 2 + 50 * {_bit('b')} - 75) / (sqrt(150.0) / 2) AS z FROM p, {_range}), e AS (SELECT *, abs(z) / sqrt(2.0) AS x FROM v)", "e", "(SELECT 1)")


@query(f"{P} SELECT object, list_bool_and(list_transform(a, lambda x: x = 0)) AS real_zero, list_bool_and(list_transform(list_transform(a, lambda x: x * 0), lambda x: x = 0)) AS made_zero, CAST({W} AS INTEGER) AS n FROM p")
def vector_zero(spark, d):
    a = F.col("a")
    return pairs_of_store(spark, d).select("object", V.is_zero(a).alias("real_zero"), V.is_zero(G.zero(W)).alias("made_zero"), F.size(G.zero(W)).alias("n"))


# permutations

_perm = lambda name: f"SELECT i, CAST(row_number() OVER (ORDER BY md5({name} || '#' || i)) - 1 AS INTEGER) AS rank FROM {_range}"
#: places: rank-th place of the permutation is i
_PERM = f", m AS (SELECT rank, CAST(i AS INTEGER) AS place FROM ({_perm("'left'")}))"


def _named() -> Column:
    return V.permutation(F.lit("left"), W)


@query(f"WITH {S.STORE}{_PERM} SELECT object, rank AS i, CAST(place AS DOUBLE) AS val FROM m, (SELECT 1::BIGINT AS object UNION ALL SELECT 2) ORDER BY 1, 2".replace(f"WITH {S.STORE}, m", "WITH m") + "")
def permutation_random(spark, d):
    return entries(spark.range(1, 3).withColumnRenamed("id", "object"), _named())


@query(f"WITH {_PERM[2:]} SELECT 1::BIGINT AS object, place AS i, CAST(rank AS DOUBLE) AS val FROM m")
def permutation_inverse(spark, d):
    return entries(spark.range(1, 2).withColumnRenamed("id", "object"), V.inverse(_named()))


_over_pairs("permutation_apply", lambda a, b: V.scattered(a, _named()), "a[rank + 1]", _PERM, "p, m", "(SELECT 1) u(u)")
ORACLES["permutation_apply"] = f"{P}{_PERM} SELECT object, place AS i, round(a[rank + 1], 6) + 0.0 AS val FROM p, m"
_over_pairs("permutation_undone", lambda a, b: V.scattered(V.scattered(a, _named()), V.inverse(_named())), "a[i + 1]")


@query(f"""WITH {_PERM[2:]}, c AS (SELECT i, row_number() OVER (ORDER BY md5('swap#' || i)) AS n FROM {_range}), pick AS (SELECT i, n, CAST(floor((n + 1) / 2.0) AS INTEGER) AS g FROM c WHERE n <= {2 * (W // 4 // 2)}),
  pair AS (SELECT x.i, y.i AS other FROM pick x JOIN pick y ON x.g = y.g AND x.n <> y.n)
  SELECT 1::BIGINT AS object, m.rank AS i, CAST(coalesce(n.place, m.place) AS DOUBLE) AS val FROM m LEFT JOIN pair ON pair.i = m.rank LEFT JOIN m n ON n.rank = pair.other""")
def permutation_swapped(spark, d):
    return entries(spark.range(1, 2).withColumnRenamed("id", "object"), V.swapped(_named(), F.lit("swap")))


_two = f", q AS (SELECT object, list_transform(range({W}), lambda i: CAST(floor(abs(a[i + 1]) * 1000) AS BIGINT) % {W}) AS a, list_transform(range({W}), lambda i: CAST(floor(abs(b[i + 1]) * 1000) AS BIGINT) % {W}) AS b FROM p)"
_ints = lambda f: lambda a, b: f(*(F.transform(v, lambda x: F.floor(F.abs(x) * 1000) % W) for v in (a, b)))
_over_pairs("permutation_type_superpose", _ints(lambda a, b: G.modular_sum(a, b, W)), f"(a[i + 1] + b[i + 1]) % {W}", _two, "q")
_over_pairs("permutation_type_bind", _ints(lambda a, b: G.modular_product(a, b, W)), f"(a[i + 1] * b[i + 1]) % {W}", _two, "q")
_over_pairs("permutation_type_release", _ints(lambda a, b: G.modular_quotient(a, b, W)), f"CASE WHEN b[i + 1] = 0 THEN 0 ELSE (a[i + 1] // b[i + 1]) % {W} END", _two, "q")


@query(f"{P}{_two} SELECT object, round(list_avg(list_transform(range({W}), lambda i: CASE WHEN a[i + 1] = b[i + 1] THEN 1.0 ELSE 0.0 END)), 6) AS score FROM q")
def permutation_type_overlap(spark, d):
    x = pairs_of_store(spark, d).select("object", _ints(lambda a, b: G.equal_share(a, b))(F.col("a"), F.col("b")).alias("score"))
    return x.select("object", rounded(F.col("score")).alias("score"))


# orthogonalisation and projection

_pre = lambda x: f"list_transform({x}, lambda c: c / sqrt(list_inner_product({x}, {x})))"
_minus = lambda x, u: f"list_transform(range({W}), lambda i: {x}[i + 1] - list_inner_product({x}, {u}) * {u}[i + 1])"
_GS3 = f"""WITH {S.STORE}, t AS (SELECT x.object, {_pre('x.vec')} AS a, {_pre('y.vec')} AS b, {_pre('z.vec')} AS c FROM s x JOIN s y ON y.object = x.object + 1 JOIN s z ON z.object = x.object + 2),
  u1 AS (SELECT object, a, {_minus('b', 'a')} AS b, {_minus('c', 'a')} AS c FROM t), u2 AS (SELECT object, a, {_pre('b')} AS b, c FROM u1), u3 AS (SELECT object, a, b, {_minus('c', 'b')} AS c FROM u2)"""


@query(f"{_GS3} SELECT object, CAST(i AS INTEGER) AS i, round(c[i + 1] / sqrt(list_inner_product(c, c)), 6) + 0.0 AS val FROM u3, {_range}")
def orthogonal_third(spark, d):
    from ..operators import search

    s = store(spark, d)
    third = s.select((F.col("object") - 2).alias("object"), F.col("vec").alias("c"))
    basis = pairs_of_store(spark, d).join(third, "object").select("object", search.orthonormal(F.array("a", "b", "c")).alias("basis"))
    return entries(basis, F.get("basis", F.lit(2)))


@query(f"{P} SELECT object, round(1 - 2.0 * list_sum(list_transform(range({W}), lambda i: {_xor})) / {W}, 6) + 0.0 AS before, 0.0::DOUBLE AS after FROM p")
def binary_orthogonal(spark, d):
    """The overlap of a pair's bits before and after the second is made orthogonal to the first."""
    a, b = _signs(F.col("a")), _signs(F.col("b"))
    made = pairs_of_store(spark, d).select("object", a.alias("a"), b.alias("b"), G.bits_orthogonal(b, a).alias("c"))
    return made.select("object", rounded(G.bit_overlap(F.col("a"), F.col("b"))).alias("before"), rounded(G.bit_overlap(F.col("a"), F.col("c"))).alias("after"))
