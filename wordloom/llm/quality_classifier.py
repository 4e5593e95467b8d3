"""Quality classifier: a convolutional network over bytes, in numpy.

Every byte becomes a learned vector of `DEPTH` numbers. `FILTERS` learned filters of
`WIDTH` bytes slide by one over chunks of `CHUNK` bytes; consecutive chunks share
WIDTH - 1 bytes, so that no window of a document is missed, and the last chunk
ends with the document. Each filter keeps its maximum of each chunk; the largest
and the mean of a document's chunk maxima go through one logistic layer to a
single probability.

A document is good if it is labelled quality 1 and toxic 0. The network is
trained on the driver, from a fixed seed, on at most `TRAIN_ROWS` labelled
documents, whole and of any length, those of least hash (ties by doc_id): half of
them good, a quarter toxic, a quarter of low quality, as far as there are any.

Defined cases: null and empty texts have probability 0 and are not kept. Texts
shorter than a filter are filled up with zero bytes; of long texts every window
counts. Repeated rows repeat their results. Without labelled documents of both kinds
there is nothing to learn: the probability is the share of good ones, or 0.5 without
any. Labels that contradict one another count each. Only doc_id and text, and of the
labels doc_id, quality and toxic, are read, whatever the names of other columns. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_side, tidy, utf8

WIDTH, DEPTH, FILTERS = 6, 4, 32
CHUNK = 8192
TRAIN_ROWS = 3000
EPOCHS = 12
BATCH = 16
KEPT = 0.5


@dataclass
class Network:
    table: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.shift, self.weights]


def chunks(n: int) -> list[tuple[int, int]]:
    """The chunks of a text of n bytes: WIDTH - 1 bytes are in two of them."""
    step = CHUNK - WIDTH + 1
    return [(a, min(a + CHUNK, n)) for a in range(0, max(n - WIDTH + 1, 1), step)]


def padded(data: np.ndarray) -> np.ndarray:
    return data if len(data) >= WIDTH else np.r_[data, np.zeros(WIDTH - len(data), np.uint8)]


def pooled(net: Network, data: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The filters' maxima of each chunk, and where they are."""
    data = padded(data)
    out, at = [], []
    for a, b in chunks(len(data)):
        flat = net.table[data[a:b]].ravel()
        windows = np.lib.stride_tricks.as_strided(flat, (b - a - WIDTH + 1, WIDTH * DEPTH), (DEPTH * flat.itemsize, flat.itemsize))
        y = windows @ net.filters
        if places:
            best = y.argmax(axis=0)
            at.append(best + a)
            out.append(y[best, np.arange(FILTERS)])
        else:
            out.append(y.max(axis=0))
    return np.stack(out) + net.shift, np.stack(at) if places else None


def _activate(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0)


def probability(net: Network, data: np.ndarray) -> float:
    if not len(data):
        return 0.0
    h = _activate(pooled(net, data)[0])
    x = np.r_[h.max(axis=0), h.mean(axis=0)]
    return float(1 / (1 + np.exp(-(x @ net.weights + net.bias))))


def backward(net: Network, data: np.ndarray, good: float, weight: float, mask: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Slopes of weight times one text's log loss, by parameter, and that of the bias; mask: what dropout leaves."""
    slopes = [np.zeros_like(p) for p in net.parameters()]
    z, at = pooled(net, data, True)
    h = _activate(z)
    top = h.argmax(axis=0)
    x = np.r_[h[top, np.arange(FILTERS)], h.mean(axis=0)]
    p = 1 / (1 + np.exp(-((x * mask) @ net.weights + net.bias)))
    e = net.weights.dtype.type((p - good) * weight)
    slopes[3] += e * x * mask
    dx = e * net.weights * mask
    dh = np.repeat(dx[None, FILTERS:] / len(h), len(h), axis=0)
    dh[top, np.arange(FILTERS)] += dx[:FILTERS]
    dz = dh * (z > 0)
    slopes[2] += dz.sum(axis=0)
    c, k = np.nonzero(dz)
    if len(c):
        codes = data[at[c, k][:, None] + np.arange(WIDTH)]
        seen = net.table[codes].reshape(len(c), -1)
        np.add.at(slopes[1].T, k, dz[c, k][:, None] * seen)
        np.add.at(slopes[0], codes.ravel(), (dz[c, k][:, None] * net.filters.T[k]).reshape(-1, DEPTH))
    return slopes, float(e)


def train(texts: list[bytes], good: list[int], seed: int = 3, epochs: int = EPOCHS) -> Network:
    """Adam on the log loss; both kinds weigh alike."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Network(rng.normal(0, 0.5, (256, DEPTH)).astype(f32), rng.normal(0, 0.4, (WIDTH * DEPTH, FILTERS)).astype(f32), np.zeros(FILTERS, f32), rng.normal(0, 0.1, 2 * FILTERS).astype(f32), 0.0)
    y = np.array(good, f32)
    share = float(y.mean()) if len(y) else 0.5
    if len(set(good)) < 2:
        net.weights[:] = 0
        net.bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return net
    data = [padded(np.frombuffer(t, np.uint8)) for t in texts]
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    m_bias = v_bias = step = 0.0
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(f32)
    for epoch in range(epochs):
        rate = 0.01 * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs)) + 1e-4
        order = rng.permutation(len(data))
        for b in range(0, len(order), BATCH):
            slopes = [np.zeros_like(p) for p in net.parameters()]
            slope_bias, part = 0.0, order[b : b + BATCH]
            for i in part:
                # dropout
                mask = np.tile(rng.random(FILTERS) > 0.1, 2) / f32(0.9)
                own, bias = backward(net, data[i], y[i], weight[i] / len(part), mask)
                slope_bias += bias
                for total, slope in zip(slopes, own):
                    total += slope
            step += 1
            for p, s, m, v in zip(net.parameters(), slopes, first, second):
                m += 0.1 * (s - m)
                v += 0.001 * (s * s - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(f32)
            m_bias += 0.1 * (slope_bias - m_bias)
            v_bias += 0.001 * (slope_bias**2 - v_bias)
            net.bias -= rate * (m_bias / (1 - 0.9**step)) / (np.sqrt(v_bias / (1 - 0.999**step)) + 1e-8)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, good) of the bounded sample by hash: at most half good, a quarter toxic, a quarter of low quality."""
    toxic, low = F.coalesce("toxic", F.lit(0)) == 1, F.col("quality") != 1
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.when(toxic, 1).when(low, 2).otherwise(0).alias("kind"))
    texts = docs.where(F.length("text") > 0).select("doc_id", "text")
    ids = texts.select("doc_id").distinct().join(known, "doc_id").select("doc_id", "kind", F.xxhash64("doc_id").alias("h"))
    parts = [ids.where(F.col("kind") == k).orderBy("h", "doc_id").limit(max(1, rows // n)) for k, n in ((0, 2), (1, 4), (2, 4))]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return texts.join(small_side(chosen, rows), "doc_id").select("doc_id", "text", (F.col("kind") == 0).cast("int").alias("good"))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    sample = sorted((r.doc_id, r.text, r.good) for r in training_rows(docs, labels, rows).collect())
    return train([t.encode() for _, t, _ in sample], [g for _, _, g in sample])


def _scorer(net: Network):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, valid = utf8(batch.column(1))
            p = [probability(net, data[a:b]) if ok else 0.0 for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "probability"])

    return score


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, probability, keep) of every row of docs."""
    p = lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_scorer(net)), "doc_id long, probability double")
    return p.withColumn("keep", F.col("probability") >= KEPT)
