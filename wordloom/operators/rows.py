"""Row vectors of plain tables, a batch at a time: each distinct cell's vector is made once a batch, rows are sums of gathered cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models

#: Rows of a partition: a small file is one split, and its rows are cheap to send but dear to work out.
PART_ROWS = 20_000
#: Rows worked out at once.
ROWS = 4_000


def spread(df: DataFrame) -> DataFrame:
    """df in partitions of about PART_ROWS rows."""
    return df.repartition(max(1, -(-df.count() // PART_ROWS)))


def bound(one: str, two: str, space: models.Space) -> tuple[np.ndarray, np.ndarray]:
    """The convolution of two keys' elemental vectors, and which places it has."""
    def at(key: str) -> np.ndarray:
        return np.array([int(hashlib.md5(f"{key}#{k}".encode()).hexdigest()[:8], 16) % space.dimension for k in range(space.seed)])

    sign = np.where(np.arange(space.seed) < space.seed // 2, 1.0, -1.0)
    to = ((at(one)[:, None] + at(two)[None]) % space.dimension).ravel()
    return np.bincount(to, np.outer(sign, sign).ravel(), space.dimension), np.bincount(to, minlength=space.dimension) > 0


def _vectors(batches: Iterator[pa.RecordBatch], strings: list[str], numbers: list[str], space: models.Space) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, normalised vectors with NaN for null, places that a row has) of a batch's rows: key, strings and shares."""
    ends = {c: (bound(f"{c}<", c, space), bound(f"{c}>", c, space)) for c in numbers}
    cells: dict[tuple[str, str], tuple] = {}
    for whole in batches:
        for i in range(0, len(whole), ROWS):
            batch = whole.slice(i, ROWS)
            val, there, known = np.zeros((len(batch), space.dimension)), np.zeros((len(batch), space.dimension), bool), np.zeros((len(batch), space.dimension), bool)
            for n, c in enumerate(strings, 1):
                coded = batch.column(n).dictionary_encode()
                if not len(coded.dictionary):
                    continue
                for v in coded.dictionary.to_pylist():
                    if (c, v) not in cells:
                        if len(cells) > 100_000:
                            cells.clear()
                        cells[c, v] = bound(f"{c}={v}", c, space)
                m, has = (np.stack(x) for x in zip(*(cells.get((c, v)) or bound(f"{c}={v}", c, space) for v in coded.dictionary.to_pylist())))
                own = np.asarray(coded.is_valid(), bool)
                code = coded.indices.drop_null().to_numpy()
                val[own] += m[code]
                there[own] |= has[code]
                known[own] |= has[code]
            for n, c in enumerate(numbers, 1 + len(strings)):
                valid = np.asarray(batch.column(n).is_valid(), bool)
                p = batch.column(n).fill_null(0.0).to_numpy()
                for (m, has), w in zip(ends[c], (1 - p, p)):
                    val += np.where(valid, w, 0.0)[:, None] * m
                    there |= has
                    known |= has & valid[:, None]
            norm = np.linalg.norm(val, axis=1, keepdims=True)
            val = np.divide(val, norm, out=np.zeros_like(val), where=norm > 0)
            val[~known & (norm > 0)] = np.nan
            yield batch.column(0), val, there


def _wide(df: DataFrame, key: str, strings: list[str], numbers: list[str]) -> DataFrame:
    """The key as text, the strings, and each number's share of the way from its column's least to its greatest."""
    wide = spread(df.select(key, *strings, *numbers)).crossJoin(F.broadcast(df.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in numbers for f in (F.min, F.max)))))
    def share(c: str):
        span = F.col(f"max_{c}") - F.col(f"min_{c}")
        return F.when(span > 0, (F.col(c) - F.col(f"min_{c}")) / span).otherwise(F.lit(0.0)).cast("double").alias(c)

    return wide.select(F.col(key).cast("string").alias("object"), *strings, *map(share, numbers))


def unrepeated(df: DataFrame, key: str) -> bool:
    return df.groupBy(key).count().where("count > 1").isEmpty()


def vectors(df: DataFrame, key: str, strings: list[str], numbers: list[str], space: models.Space) -> DataFrame:
    """(object, dim, val) of models.table_rows(), normalised; rows that share a key are added there."""
    if not unrepeated(df, key):
        return models.normalised(models.table_rows(df, key, strings, numbers, space))

    def long(batches):
        for keys, val, there in _vectors(batches, strings, numbers, space):
            row, dim = np.nonzero(there)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(dim.astype(np.int32)), pa.array(val[row, dim], from_pandas=True)], names=["object", "dim", "val"])

    return _wide(df, key, strings, numbers).mapInArrow(long, "object string, dim int, val double")


def scores(df: DataFrame, key: str, strings: list[str], numbers: list[str], space: models.Space, query: dict[int, float]) -> DataFrame:
    """(object, x): the rows' products with a query (value by place), of the rows that share a place with it."""
    if not unrepeated(df, key):
        q = df.sparkSession.createDataFrame(list(query.items()), "dim int, q double")
        return models.normalised(models.table_rows(df, key, strings, numbers, space)).join(F.broadcast(q), "dim").groupBy("object").agg(F.sum(F.col("val") * F.col("q")).alias("x"))
    at, q = np.array(sorted(query), int), np.array([query[k] for k in sorted(query)], float)

    def product(batches):
        for keys, val, there in _vectors(batches, strings, numbers, space):
            near = there[:, at].any(axis=1)
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(near)), pa.array((np.nan_to_num(val[near][:, at]) * q).sum(axis=1))], names=["object", "x"])

    return _wide(df, key, strings, numbers).mapInArrow(product, "object string, x double")
