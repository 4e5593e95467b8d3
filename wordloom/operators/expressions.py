"""The query language of bound products.

    expression = sum { "|" sum }          balanced: the parts are added
    sum        = product { "+" product }  bundled
    product    = atom { "*" atom }        bound from left to right: the next released from what there is
    atom       = ("E" | "S" | "P") "(" term { "~NOT" term } ")"

E is the elemental vector of a name, S the stored one, P that of a predicate. What
stands behind ~NOT is taken out of the atom's vector. A name that is not stored is a
zero vector, and with it its product. Parsing is the driver's; the
result is a table of one row, as for every other query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import models, search

_ATOM = re.compile(r"\s*([ESP])\(\s*([^()]*?)\s*\)\s*")


@dataclass(frozen=True)
class Atom:
    kind: str
    term: str
    without: tuple[str, ...] = field(default=())


def parsed(text: str) -> list[list[list[Atom]]]:
    """Parts of sums of products of atoms."""
    def atom(one: str) -> Atom:
        if not (m := _ATOM.fullmatch(one)):
            raise ValueError(f"not an atom: {one!r}")
        term, *rest = re.split(r"\s*~NOT\s+", m[2], flags=re.IGNORECASE)
        if not term:
            raise ValueError(f"an atom without a term: {one!r}")
        return Atom(m[1], term, tuple(rest))

    return [[[atom(a) for a in product.split("*")] for product in total.split("+")] for total in text.split("|")]


class Spaces:
    """What atoms are looked up in: a store for S, one for P (E of the name where there is none), and the elemental vectors' space."""

    def __init__(self, store: DataFrame, space: models.Space, predicates: DataFrame | None = None, method: str = "plain"):
        self.store, self.space, self.predicates, self.method = store, space, predicates, method

    def row(self, atoms: list[Atom]) -> DataFrame:
        """One row: s and p, the vectors of all names by name."""
        names = sorted({t for a in atoms for t in (a.term, *a.without)})
        def held(df: DataFrame | None, label: str) -> DataFrame:
            none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<double>>"))
            if df is None:
                return self.store.sparkSession.range(1).select(none.alias(label))
            found = df.select(F.col("object").cast("string").alias("object"), "vec").where(F.col("object").isin(names)).groupBy("object").agg(F.min("vec").alias("vec"))
            return found.agg(F.map_from_entries(F.collect_list(F.struct("object", "vec"))).alias(label))
        return held(self.store, "s").crossJoin(held(self.predicates, "p"))

    def one(self, kind: str, name: str) -> Column:
        if kind == "E" or kind == "P" and self.predicates is None:
            return models.elemental_vector(F.lit(name), self.space)
        return F.coalesce(F.try_element_at(kind.lower(), F.lit(name)), F.array_repeat(F.lit(0.0), self.space.dimension))

    def atom(self, a: Atom) -> Column:
        out = self.one(a.kind, a.term)
        if a.without:
            basis = search.orthonormal(F.array(*(self.one(a.kind, t) for t in a.without)))
            out = V.normalise(F.aggregate(basis, V.normalise(out), lambda x, u: V.superpose(x, u, -V.dot(x, u))))
        return out

    def product(self, atoms: list[Atom]) -> Column:
        out = self.atom(atoms[0])
        for a in atoms[1:]:
            out = V.release(self.atom(a), out, self.method)
        return out


def _products(text: str) -> list[list[Atom]]:
    return [p for total in parsed(text) for p in total]


def query(spaces: Spaces, text: str) -> DataFrame:
    """One row: q, the normalised vector of an expression; each part of a balanced one counts alike."""
    parts = []
    for total in parsed(text):
        q = spaces.product(total[0])
        for p in total[1:]:
            q = V.superpose(q, spaces.product(p))
        parts.append(V.normalise(q))
    q = parts[0]
    for p in parts[1:]:
        q = V.superpose(q, p)
    return spaces.row([a for p in _products(text) for a in p]).select(V.normalise(q).alias("q"))


def basis(spaces: Spaces, text: str) -> DataFrame:
    """One row: the orthonormal basis of what an expression's products span."""
    products = _products(text)
    return spaces.row([a for p in products for a in p]).select(search.orthonormal(F.array(*(spaces.product(p) for p in products))).alias("basis"))


def found(spaces: Spaces, text: str, k: int = 20) -> DataFrame:
    """The stored rows nearest to an expression."""
    return search.best(search.near(spaces.store, query(spaces, text)), k)


def found_in_subspace(spaces: Spaces, text: str, k: int = 20) -> DataFrame:
    """The stored rows by their projection on what the products span."""
    b = basis(spaces, text).where(F.size("basis") > 0)
    return search.best(search.scored(spaces.store, b, search.projected(F.col("vec"), F.col("basis"))), k)


def compared(spaces: Spaces, one: str, two: str) -> DataFrame:
    """One row: the cosine of two expressions, 0 if either is zero."""
    return query(spaces, one).select(F.col("q").alias("a")).crossJoin(query(spaces, two)).select(F.round(V.cosine(F.col("a"), F.col("q")), 6).alias("score"))
