"""The ground fields beyond real vectors: complex (pairs of coordinates, or phases), binary (arrays of 0 and 1), permutations.

Random vectors are expressions of a key's md5; coins are hashes of a name and a place, so that they fall alike on every run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V

PHASES = V.PHASES


def zero(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def _places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _number(key: Column) -> Column:
    """32 bits of a key's md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def coin(name: str, i: Column) -> Column:
    """A number from 0 to 1 that a name and a place give."""
    return _number(F.concat(F.lit(f"{name}#"), i.cast("string"))) / F.lit(4294967296.0)


def _rank(key: Column, n: int) -> Column:
    """Places in the order of the md5 of key and place."""
    return V.permutation(key, n)


# random vectors


def elemental_bits(key: Column, n: int) -> Column:
    """Exactly half of the places are 1."""
    return V.let(F.slice(_rank(key, n), 1, n // 2), lambda ones: F.transform(_places(n), lambda i: F.when(F.array_contains(ones, i), 1.0).otherwise(0.0)))


def elemental_phases(key: Column, n: int, seed: int) -> Column:
    """A random phase at `seed` distinct places, -1 elsewhere."""
    some = F.slice(_rank(key, n), 1, seed)
    return V.let(some, lambda chosen: F.transform(_places(n), lambda i: F.when(F.array_contains(chosen, i), _number(F.concat(key, F.lit("@"), i.cast("string"))) % PHASES).otherwise(F.lit(-1)).cast("int")))


def elemental_dense(key: Column, n: int) -> Column:
    """Evenly from -1/2n to 1/2n."""
    return F.transform(_places(n), lambda i: (_number(F.concat(key, F.lit("@"), i.cast("string"))) / F.lit(4294967296.0) - 0.5) / n)


# complex vectors: even places real, odd ones imaginary


def phase_superpose(a: Column, b: Column, weight: float = 1.0) -> Column:
    """The sum of two phase vectors, in coordinates."""
    return V.superpose(V.cartesian(a), V.cartesian(b), weight)


def _pairs(n: Column) -> Column:
    return F.sequence(F.lit(0), (n / 2).cast("int") - 1)


def _complex(a: Column, b: Column, body) -> Column:
    """A vector whose pairs are body(re a, im a, re b, im b)."""
    at = lambda v, i: F.get(v, i)
    return V.let(a, lambda x: V.let(b, lambda y: F.flatten(F.transform(_pairs(F.size(x)), lambda j: F.array(*body(at(x, 2 * j), at(x, 2 * j + 1), at(y, 2 * j), at(y, 2 * j + 1)))))))


def unit_circle(a: Column) -> Column:
    """Every pair of coordinates at length 1; zero pairs stay."""
    def one(x, y, _, __):
        n = F.sqrt(x * x + y * y)
        return F.when(n > 0, x / n).otherwise(F.lit(0.0)), F.when(n > 0, y / n).otherwise(F.lit(0.0))

    return _complex(a, a, one)


def hermitian_bind(a: Column, b: Column) -> Column:
    """The product pair by pair, at length 1."""
    return V.normalise(_complex(a, b, lambda x, y, u, v: (x * u - y * v, x * v + y * u)))


def hermitian_release(a: Column, b: Column) -> Column:
    """The product with the conjugate of b, at length 1."""
    return V.normalise(_complex(a, b, lambda x, y, u, v: (x * u + y * v, y * u - x * v)))


def hermitian_without(a: Column, b: Column) -> Column:
    """b less its Hermitian projection on a, at length 1."""
    def rest(x: Column, y: Column) -> Column:
        product = V.let(_complex(y, x, lambda p, q, u, v: (p * u + q * v, q * u - p * v)), lambda c: F.struct(_every(c, 0).alias("re"), _every(c, 1).alias("im")))
        scale = V.dot(x, x)
        return V.let(F.struct(product.alias("c"), scale.alias("n")), lambda s: V.superpose(y, _complex(x, x, lambda p, q, _, __: ((s["c"]["re"] * p - s["c"]["im"] * q) / s["n"], (s["c"]["re"] * q + s["c"]["im"] * p) / s["n"])), -1.0))

    return V.normalise(V.let(a, lambda x: V.let(b, lambda y: F.when(V.is_zero(x), y).otherwise(rest(x, y)))))


def _every(v: Column, k: int) -> Column:
    """The sum of every second coordinate, from the k-th."""
    return F.aggregate(F.filter(v, lambda x, i: i % 2 == k), F.lit(0.0), lambda s, x: s + x)


def cartesian_overlap(a: Column, b: Column) -> Column:
    """The mean cosine of the pairs that are zero in neither; 0 without any."""
    def one(x, y, u, v):
        n = F.sqrt((x * x + y * y) * (u * u + v * v))
        return F.when(n > 0, (x * u + y * v) / n).otherwise(F.lit(0.0)), F.when(n > 0, F.lit(1.0)).otherwise(F.lit(0.0))

    return V.let(_complex(a, b, one), lambda c: F.when(_every(c, 1) > 0, _every(c, 0) / _every(c, 1)).otherwise(F.lit(0.0)))


# binary vectors as arrays of 0.0 and 1.0


def unpacked(words: Column, n: int) -> Column:
    """Packed words of 64 bits as an array."""
    return F.transform(_places(n), lambda i: F.call_function("shiftrightunsigned", F.get(words, (i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1)).cast("double"))


def votes(weighted: list[tuple[Column, float]]) -> Column:
    """Sums of round(100 w) for each 1, and less that for each 0; a negative weight is the complement's."""
    def of(bits: Column, w: float) -> Column:
        return F.transform(bits, lambda x: (2 * x - 1) * round(100 * w))

    out = of(*weighted[0])
    for p in (of(*x) for x in weighted[1:]):
        out = F.zip_with(out, p, lambda x, y: x + y)
    return out


def majority(n: Column) -> Column:
    """The bits that votes decide; ties alternate from 0 in the order of places."""
    return V.let(n, lambda v: F.transform(v, lambda x, i: F.when(x > 0, 1.0).when(x < 0, 0.0).otherwise((F.size(F.filter(F.slice(v, 1, i + 1), lambda y: y == 0)) + 1) % 2).cast("double")))


def _erf(x: Column) -> Column:
    """Four terms, for x of 0 or more."""
    return 1 - 1 / F.pow(1 + 0.278393 * x + 0.230389 * x * x + 0.000972 * F.pow(x, 3) + 0.078108 * F.pow(x, 4), F.lit(4.0))


def probabilistic(n: Column, total: float) -> Column:
    """Bits drawn by how far votes are from a tie, in standard deviations of so many fair votes; the coins are fixed by place."""
    def bit(x, i):
        z = (x + total) / 2 - total / 2
        z = z / (F.sqrt(F.lit(float(total))) / 2)
        return F.when(coin("normal", i) < 0.5 * (1 + F.signum(z) * _erf(F.abs(z) / F.sqrt(F.lit(2.0)))), 1.0).otherwise(0.0)

    return F.transform(n, bit)


def _with(a: Column, b: Column, body) -> Column:
    """body(a_i, b_i, i)."""
    return V.let(b, lambda y: F.transform(a, lambda x, i: body(x, F.get(y, i), i)))


def intersection(a: Column, b: Column, seed: str = "23") -> Column:
    """Common bits stay; where they differ a coin turns a's bit."""
    return _with(a, b, lambda x, y, i: F.when(x == y, x).when(coin(seed, i) < 0.5, 1 - x).otherwise(x))


def weighted_bits(a: Column, b: Column, w: float, v: float) -> Column:
    """Each bit is 1 with the probability of the two bits' weighted mean."""
    return _with(a, b, lambda x, y, i: F.when(coin("weighted", i) < (w * x + v * y) / (w + v), 1.0).otherwise(0.0))


def bit_overlap(a: Column, b: Column) -> Column:
    return 1 - 2 * F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def bits_orthogonal(b: Column, a: Column, seed: str = "23") -> Column:
    """b with the fewest bits turned, chosen by coins, that make it agree with a in half of the places."""
    def turned(x: Column, y: Column) -> Column:
        same = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
        surplus = same - (F.size(x) / 2).cast("int")
        wanted = F.when(surplus > 0, F.lit(True)).otherwise(F.lit(False))
        keyed = F.filter(F.transform(y, lambda q, i: F.struct((F.get(x, i) == q).alias("same"), coin(seed, i).alias("h"), i.alias("i"))), lambda e: e["same"] == wanted)
        chosen = F.transform(F.slice(F.array_sort(F.transform(keyed, lambda e: F.struct(e["h"].alias("h"), e["i"].alias("i")))), 1, F.abs(surplus)), lambda e: e["i"])
        return V.let(chosen, lambda c: F.transform(y, lambda q, i: F.when(F.array_contains(c, i), 1 - q).otherwise(q)))

    return V.let(a, lambda x: V.let(b, lambda y: turned(x, y)))


# permutations as vectors of numbers below n


def modular_sum(a: Column, b: Column, n: int) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) % n)


def modular_product(a: Column, b: Column, n: int) -> Column:
    return F.zip_with(a, b, lambda x, y: (x * y) % n)


def modular_quotient(a: Column, b: Column, n: int) -> Column:
    """Whole quotients; nothing divided by 0 is 0."""
    return F.zip_with(a, b, lambda x, y: F.when(y == 0, F.lit(0)).otherwise(F.floor(x / F.when(y == 0, F.lit(1)).otherwise(y)) % n))


def equal_share(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


class Field:
    """A ground field: what searchers and models need of it, as column builders. Another field is another such class."""

    def __init__(self, bind, release, superpose, normalise, overlap):
        self.bind, self.release, self.superpose, self.normalise, self.overlap = bind, release, superpose, normalise, overlap


FIELDS = {
    "real": Field(V.bind, V.release, V.superpose, V.normalise, V.cosine),
    "complex": Field(hermitian_bind, hermitian_release, V.superpose, unit_circle, cartesian_overlap),
    "binary": Field(lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda a, b, w=1.0: votes([(a, 1.0), (b, w)]), majority, bit_overlap),
}


def orthogonalised(kind: str, a: Column, b: Column) -> Column:
    """b made orthogonal to a, by the field's own measure."""
    return {"real": lambda: V.without(b, a), "complex": lambda: hermitian_without(a, b), "binary": lambda: bits_orthogonal(b, a)}[kind]()
