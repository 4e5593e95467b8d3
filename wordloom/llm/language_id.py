"""Language identification by sparse multinomial logistic regression.

Features are the TF-IDF weights of character n-grams (1 to `LONGEST` characters of
the lower-cased text, all digits as one, hashed to `BUCKETS` places): (1 + ln tf)
times ln((1 + N) / (1 + df)) + 1, divided by the Euclidean norm. Document
frequencies come from every document. The weights are fitted on the driver with
follow-the-regularised-leader (FTRL-proximal) steps under an elastic net, on at
most `TRAIN_ROWS` documents of known language, those of least hash, as many of
each language as there are, up to its share. A fifth of them is held out, and the
temperature that divides the scores is chosen to give these the least log loss.

Defined cases: null and empty texts have no language (null) and probability 0.
Rows repeat their results. With a single known language every text gets it; with
none every language is null. A null language is not learnt from. Ties go to the
language first in the alphabet. All of a text's n-grams count, however long it is.
Only doc_id, text and lang are read, whatever the names of other columns. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, lean, lowered, small_side, tidy

LONGEST = 3
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
TRAIN_ROWS = 3000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a lower-cased text's n-grams and their counts."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    codes = np.where((codes >= 48) & (codes <= 57), U64(48), codes)
    total = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(codes), U64)
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * U64(0x9E3779B97F4A7C15) + codes[n - 1 :] + U64(n)
        total += np.bincount(((h * U64(0xBF58476D1CE4E5B9)) >> U64(64 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = gram_counts(text)
    v = (1 + np.log(tf)) * idf[at]
    return at, v / np.sqrt(v @ v) if len(v) else v


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray:
        at, v = vector(text, self.idf)
        return v @ self.weights[at] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that minimise the linearised loss so far plus the elastic net."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(texts: list[str], languages: list[str], idf: np.ndarray, seed: int = 9) -> Model:
    names = sorted(set(languages))
    k = len(names)
    model = Model(names, idf, np.zeros((BUCKETS, k)), np.zeros(k), 1.0)
    if k < 2:
        return model
    y = np.array([names.index(x) for x in languages])
    rows = [vector(t, idf) for t in texts]
    order = np.random.default_rng(seed).permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    for _ in range(EPOCHS):
        for i in used:
            at, v = np.r_[rows[i][0], BUCKETS], np.r_[rows[i][1], 1.0]
            w = _leader(z[at], n[at])
            p = softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = new
    w = _leader(z, n)
    model.weights, model.bias = w[:-1], w[-1]
    if len(held):
        scores = np.stack([rows[i][1] @ model.weights[rows[i][0]] + model.bias for i in held])
        model.temperature = calibrate(scores, y[held])
    return model


def calibrate(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    def loss(t: float) -> float:
        return float(-np.log(softmax(scores / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    a, b, g = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _texts(column: pa.Array) -> Iterator[str]:
    for text in lowered(column):
        yield text.as_py()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in _texts(batch.column(0)):
            df[gram_counts(text)[0]] += 1
            n += 1
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen]), pa.array(np.r_[n, df[seen]])], names=["bucket", "df"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 of every bucket, over all documents that have a text."""
    found = lean(docs).select(F.col("text").cast("string")).where("length(text) > 0").mapInArrow(tidy(_frequencies), "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    df = np.zeros(BUCKETS + 1, np.int64)
    for row in found.collect():  # a row for each bucket, however many documents
        df[row.bucket] = row.df
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, lang): the bounded sample."""
    known = docs.where("length(text) > 0 and lang is not null")
    # Spark keeps each task's first rows of a language only before it shuffles (a window group limit)
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("h"))
    kinds = ids.select("lang").distinct().count()
    each = max(1, rows // max(1, kinds))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = ids.withColumn("r", rank).where(F.col("r") <= each).select("doc_id", "h")
    keyed = known.select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    return keyed.join(small_side(chosen.distinct(), rows), ["doc_id", "h"]).select("doc_id", "text", "lang")


def fitted(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    idf = inverse_frequencies(docs)
    sample = sorted((r.doc_id or 0, r.text, r.lang) for r in training_rows(docs, rows).collect())
    lower = pc.utf8_lower(pa.array([t for _, t, _ in sample], pa.string())).to_pylist()
    return train(lower, [x for _, _, x in sample], idf)


def _classifier(model: Model):
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sure = [], []
            for text in _texts(batch.column(1)):
                if not text or not model.languages:
                    names.append(None)
                    sure.append(0.0)
                    continue
                p = softmax(model.scores(text) / model.temperature)
                names.append(model.languages[int(p.argmax())])
                sure.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "language", "probability"])

    return classify


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, probability) of every row of docs."""
    return lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_classifier(model)), "doc_id long, language string, probability double")
