"""Row-local vector algebra as column expressions, for real, complex-phase and binary vectors.

Real: ARRAY<DOUBLE>. Complex: ARRAY<INT> phases of PHASES steps, -1 for a zero coordinate.
Binary: ARRAY<BIGINT> words of 64 bits. Zero vectors stay zero when normalised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PHASES = 16384


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, not in each step of a lambda that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_zero(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def normalise(a: Column) -> Column:
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def cosine(a: Column, b: Column) -> Column:
    return let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def superpose(a: Column, b: Column, weight: float | Column = 1.0) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.zip_with(a, b, lambda x, y: x + w * y)


def scale(a: Column, weight: Column) -> Column:
    return F.transform(a, lambda x: x * weight)


def involution(a: Column) -> Column:
    """The first coordinate stays, the others turn round."""
    return F.concat(F.slice(a, 1, 1), F.reverse(F.slice(a, 2, F.size(a) - 1)))


def convolve(a: Column, b: Column) -> Column:
    """Circular convolution."""
    def sums(x: Column, y: Column) -> Column:
        # the second vector twice, last first: each coordinate is a dot product with a slice of it
        n = F.size(x)
        return let(F.reverse(F.concat(y, y)), lambda yy: F.transform(x, lambda _, k: dot(x, F.slice(yy, n - k, n))))

    return let(a, lambda x: let(b, lambda y: sums(x, y)))


def bind(a: Column, b: Column, method: str = "normalized") -> Column:
    """normalized, plain (both convolution) or permutation."""
    if method == "permutation":
        return F.zip_with(shift(b, 1), shift(a, -1), lambda x, y: x + y)
    return convolve(a, b) if method == "plain" else normalise(convolve(normalise(a), normalise(b)))


def release(a: Column, b: Column, method: str = "normalized") -> Column:
    """What bind(b, x) = a leaves of x."""
    if method == "permutation":
        return shift(F.zip_with(a, shift(b, -1), lambda x, y: x - y), -1)
    return bind(a, involution(b), method)


def shift(a: Column, by: int | Column) -> Column:
    """Coordinate i goes to place i + by."""
    return let(a, lambda v: let(F.pmod(F.lit(0) - by, F.size(v)), lambda back: F.concat(F.slice(v, back + 1, F.size(v) - back), F.slice(v, 1, back))))


def scattered(a: Column, permutation: Column) -> Column:
    """Coordinate i goes to place permutation[i]."""
    pairs = F.arrays_zip(permutation.alias("to"), a.alias("x"))
    return F.transform(F.array_sort(pairs), lambda e: e["x"])


def inverse(permutation: Column) -> Column:
    """The permutation that undoes another."""
    pairs = F.transform(permutation, lambda to, i: F.struct(to.alias("to"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda e: e["i"])


def permutation(name: Column, n: int) -> Column:
    """The random permutation of 0 to n - 1 that a name gives: places in the order of their md5."""
    keyed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.md5(F.concat(name, F.lit("#"), i.cast("string"))).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda e: e["i"])


def swapped(permutation: Column, name: Column, share: float = 0.25) -> Column:
    """A permutation near another: a share of its places, in pairs that a name chooses, change over."""
    n = F.size(permutation)
    keyed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.md5(F.concat(name, F.lit("#"), i.cast("string"))).alias("h"), i.alias("i")))
    chosen = F.transform(F.slice(F.array_sort(keyed), 1, 2 * F.floor(n * share / 2).cast("int")), lambda e: e["i"])
    def to(i):
        return F.when(i % 2 == 0, i + 1).otherwise(i - 1)
    def moved(c):
        return F.transform(permutation, lambda x, i: let(F.array_position(c, i).cast("int") - 1, lambda at: F.when(at < 0, x).otherwise(F.get(permutation, F.get(c, to(at))))))
    return let(chosen, moved)


def without(a: Column, b: Column) -> Column:
    """a less its part along b (orthogonal negation), normalised."""
    return let(normalise(b), lambda u: let(normalise(a), lambda v: let(dot(v, u), lambda c: normalise(superpose(v, u, -c)))))


def truncated(a: Column, k: int) -> Column:
    return F.slice(a, 1, k)


def to_text(a: Column) -> Column:
    return F.concat_ws("|", a.cast("array<string>"))


def from_text(a: Column) -> Column:
    return F.split(a, r"\|").cast("array<double>")


# complex phases


def phases(a: Column) -> Column:
    """Pairs of coordinates to phases."""
    angle = lambda i: F.pmod(F.atan2(F.get(a, 2 * i + 1), F.get(a, 2 * i)), F.lit(2.0) * F.pi())
    return F.transform(F.sequence(F.lit(0), (F.size(a) / 2).cast("int") - 1), lambda i: F.when((F.get(a, 2 * i) == 0) & (F.get(a, 2 * i + 1) == 0), -1).otherwise(F.floor(angle(i) * PHASES / (2 * F.pi())).cast("int") % PHASES))


def cartesian(p: Column) -> Column:
    turn = lambda x: 2 * F.pi() * x / PHASES
    return F.flatten(F.transform(p, lambda x: F.when(x < 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.cos(turn(x)), F.sin(turn(x))))))


def phase_bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when(y == -1, x).when(x == -1, y).otherwise(F.pmod(x + y, F.lit(PHASES))))


def phase_release(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when(y == -1, x).when(x == -1, y).otherwise(F.pmod(x - y, F.lit(PHASES))))


def phase_complement(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(x == -1, x).otherwise(F.pmod(x + PHASES // 2, F.lit(PHASES))))


def phase_overlap(a: Column, b: Column) -> Column:
    """Mean cosine over the coordinates that a has."""
    n = F.size(F.filter(a, lambda x: x >= 0))
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x < 0) | (y < 0), F.lit(0.0)).otherwise(F.cos(2 * F.pi() * (x - y) / PHASES))), F.lit(0.0), lambda s, v: s + v)
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


# binary words


def bits(a: Column) -> Column:
    """64 signs to a word, place i is bit i."""
    return F.array(F.aggregate(F.transform(a, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.call_function("shiftleft", F.expr("1L"), i)), F.expr("0L"), lambda s, v: s.bitwiseOR(v)))


def xor(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def complement(a: Column) -> Column:
    return F.transform(a, lambda x: F.bitwise_not(x))


def ones(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda x: F.bit_count(x)), F.lit(0), lambda s, v: s + v)


def binary_overlap(a: Column, b: Column) -> Column:
    return 1 - 2 * ones(xor(a, b)) / (64 * F.size(a))
