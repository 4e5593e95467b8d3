"""Vectors of items and predicates from counted triples (subject, predicate, object, n).

A triple stays one row: its arguments' elemental vectors are added up in numpy, by item
and predicate, and what is summed is bound with the predicate once, convolution being
linear. A vector has its values and a mask of the places that are there (`matrices`).
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import matrices, models, slabs
from .models import Space

#: Rows of a task that sums by item.
PART_ROWS = 200_000
#: Groups that are bound at once.
CHUNK = 4096


def _weight(counted: DataFrame, total: int, c: str) -> DataFrame:
    return counted.groupBy(c).agg(F.log10(F.lit(total) / F.count("*")).alias(f"w_{c}"))


def _known(counted: DataFrame) -> DataFrame:
    return counted.where("subject is not null and predicate is not null and object is not null")


def arguments(counted: DataFrame, total: int, only: DataFrame | None = None) -> DataFrame:
    """(item, other, predicate, w): of each triple the subject, by pw (w(o) + w(p)), and the object with p-INV, by pw (w(s) + w(p)). only: of a few items (item), before anything is joined by its other argument."""
    one = _known(counted).withColumn("pw", F.log10(1 + F.col("n"))).join(F.broadcast(_weight(counted, total, "predicate")), "predicate")
    def way(item: str, other: str, predicate: Column) -> DataFrame:
        own = one if only is None else one.join(F.broadcast(only), one[item] == only["item"], "left_semi")
        weighted = own.join(_weight(counted, total, other), other)
        return weighted.select(F.col(item).alias("item"), F.col(other).alias("other"), predicate.alias("predicate"), (F.col("pw") * (F.col(f"w_{other}") + F.col("w_predicate"))).alias("w"))

    return way("subject", "object", F.col("predicate")).unionByName(way("object", "subject", F.concat("predicate", F.lit("-INV"))))


def _placed(val: np.ndarray, there: np.ndarray, predicate: str, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Rows bound with a predicate's elemental vector: values, and which places there are."""
    out, known, has = np.zeros_like(val), np.zeros(val.shape, bool), matrices.places_there(there, space.dimension)
    for k, q in enumerate(_places(predicate, space)):
        turned = np.roll(val, q, axis=1)
        out += turned if k < space.seed // 2 else -turned
        known |= np.roll(has, q, axis=1)
    return out, known


def _places(key: str, space: Space) -> list[int]:
    return [int(md5(f"{key}#{k}".encode()).hexdigest()[:8], 16) % space.dimension for k in range(space.seed)]


def items(counted: DataFrame, space: Space, only: DataFrame | None = None) -> DataFrame:
    """(object, dim, val): S(s) sums pw (w(o) + w(p)) E(o) * E(p), and S(o) pw (w(s) + w(p)) E(s) * E(p-INV), normalised; * is convolution. counted is written. only: a few items (item)."""
    total, d = counted.count(), space.dimension
    given = arguments(counted, total, only)

    def spacious(val, there, n):
        if n <= len(val):
            return val, there
        more = max(n, 2 * len(val)) - len(val)
        return np.r_[val, np.zeros((more, d))], np.r_[there, np.zeros(more, np.uint64)]

    def grouped(batches):
        """Sums by item and predicate."""
        groups: dict[tuple[str, str], int] = {}
        val, there = np.zeros((1024, d)), np.zeros(1024, np.uint64)
        for batch in batches:
            item, predicate = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            n = max(1, len(predicate.dictionary))
            key, own = np.unique(item.indices.to_numpy().astype(np.int64) * n + predicate.indices.to_numpy(), return_inverse=True)
            names, kinds = item.dictionary.to_pylist(), predicate.dictionary.to_pylist()
            at = np.array([groups.setdefault((names[x // n], kinds[x % n]), len(groups)) for x in key.tolist()], np.int64)
            val, there = spacious(val, there, len(groups))
            places = batch.column(2).flatten().to_numpy().astype(np.int64).reshape(len(batch), -1)
            part = matrices.scattered(len(key), own, places, batch.column(3).to_numpy(), d)
            val[at] += part.val
            there[at] |= part.there
        return groups, val, there

    def bound(groups, val, there):
        # an item's groups, one after another
        at_item: dict[str, int] = {}
        row = np.array([at_item.setdefault(i, len(at_item)) for i, _ in groups], np.int64)
        kind = np.array([p for _, p in groups], object)
        out, known = np.zeros((len(at_item), d)), np.zeros((len(at_item), d), bool)
        for p in sorted(set(kind)):
            own = np.flatnonzero(kind == p)  # no item twice
            for i in range(0, len(own), CHUNK):
                g = own[i : i + CHUNK]
                v, has = _placed(val[g], there[g], p, space)
                out[row[g]] += v
                known[row[g]] |= has
        names = pa.array(list(at_item), pa.string())
        for i in range(0, len(names), CHUNK):
            yield from matrices._long(names.slice(i, CHUNK), known[i : i + CHUNK], {"val": matrices.unit(out[i : i + CHUNK])})

    def summed(batches):
        yield from bound(*grouped(batches))

    def partly(batches):
        groups, val, there = grouped(batches)
        if groups:
            names, n = [pa.array(x, pa.string()) for x in zip(*groups)], len(groups)
            yield pa.RecordBatch.from_arrays([*names, pa.array([v.tobytes() for v in val[:n]], pa.binary()), pa.array(there[:n].view(np.int64))], names=["item", "predicate", "val", "there"])

    def merged(batches):
        groups: dict[tuple[str, str], int] = {}
        val, there = np.zeros((1024, d)), np.zeros(1024, np.uint64)
        for batch in batches:
            masks = batch.column(3).to_numpy().view(np.uint64)
            for i, p, v, mask in zip(*(batch.column(c).to_pylist() for c in range(3)), masks):
                at = groups.setdefault((i, p), len(groups))
                val, there = spacious(val, there, len(groups))
                val[at] += np.frombuffer(v)
                there[at] |= mask
        yield from bound(groups, val, there)

    placed = lambda df: df.select("item", "predicate", models.places(F.col("other"), space).alias("at"), "w")
    if only is not None:
        # few items may have most triples: each task sums its own, only the sums go to one
        parts = placed(given).mapInArrow(slabs.tidy(partly), "item string, predicate string, val binary, there long")
        return parts.repartition(1).mapInArrow(slabs.tidy(merged), "object string, dim int, val double")
    by_item = given.repartition(max(1, -(-2 * total // PART_ROWS)), "item")
    return placed(by_item).mapInArrow(slabs.tidy(summed), "object string, dim int, val double")


def predicates(counted: DataFrame, space: Space) -> DataFrame:
    """(object, dim, val): P(p) sums w(s) w(o) E(s) * shift(E(o), 1), normalised; P(p-INV), with the arguments changed over, is the same. counted is written."""
    total, d = counted.count(), space.dimension
    one = _known(counted).select("subject", "predicate", "object")
    for c in ("subject", "object"):
        one = one.join(_weight(counted, total, c), c)
    given = one.select("predicate", *(models.places(F.col(c), space).alias(c) for c in ("subject", "object")), (F.col("w_subject") * F.col("w_object")).alias("w"))

    def summed(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            code = coded.indices.to_numpy()
            s, o = (batch.column(c).flatten().to_numpy().astype(np.int64).reshape(len(batch), -1) for c in (1, 2))
            w = batch.column(3).to_numpy()
            for n, p in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(code == n)
                val, seen = sums.setdefault(p, (np.zeros(d), np.zeros(d, bool)))
                for k in range(space.seed):
                    for j in range(space.seed):
                        to = (s[own, k] + o[own, j] + 1) % d
                        part = np.bincount(to, w[own], d)
                        val += part if (k < space.seed // 2) == (j < space.seed // 2) else -part
                        seen |= np.bincount(to, minlength=d) > 0
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v, _ in sums.values()]), pa.array([x.tolist() for _, x in sums.values()])], names=["object", "vec", "there"])

    parts = given.mapInArrow(summed, "object string, vec array<double>, there array<boolean>")
    long = parts.select("object", F.posexplode(F.arrays_zip("vec", "there")).alias("dim", "x")).where("x.there")
    sums = long.groupBy("object", "dim").agg(F.sum("x.vec").alias("val"))
    return models.normalised(sums.select(F.explode(F.array("object", F.concat("object", F.lit("-INV")))).alias("object"), "dim", "val"))
