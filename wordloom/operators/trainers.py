"""Stochastic-gradient trainers: each epoch every task moves a copy of the matrices over its own rows, and the moves are averaged row by row.

The matrices are held by the driver and every task: rows times dimension is bounded
by the vocabulary, which `MOST_ROWS` limits; a larger vocabulary is an error, not a cut.
A step touches the rows of its batch alone, so that its cost does not grow with the
vocabulary. Examples are numbers, written once; an epoch reads them as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from . import slabs

MOST_ROWS = 2_000_000
#: Matrix rows of a block that is sent.
WIDE = 8192
#: Batches whose negatives are drawn at once.
DRAWN = 64
#: Examples of a task, at least.
LEAST = 100_000
#: Tokens of a row of packed words, about.
TOKENS = 100_000

Touched = list[tuple[np.ndarray, np.ndarray]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -6, 6)))


def _added(m: np.ndarray, at: np.ndarray, move: np.ndarray, times: int = 1, power: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Adds moves to rows; a row that a batch holds often (each place counts so many times) moves by a root of its count, or frequent words would run away. (rows, counts)."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    rows, n = own[first], np.diff(np.r_[first, len(own)]) * times
    m[rows] += np.add.reduceat(move[order], first, axis=0) / (n[:, None] ** power).astype(m.dtype)
    return rows, n


def _labels(j: np.ndarray) -> np.ndarray:
    """Of each row's places the first is true, the others are drawn."""
    label = np.zeros(j.shape, np.float32)
    label[:, 0] = 1
    return label


def _step(parts: list[np.ndarray], i: np.ndarray, j: np.ndarray, rate: float) -> Touched:
    """Rows a[i] and b[j[:, 0]] toward each other, a[i] and the other b[j] from each other, from a snapshot."""
    a, b = parts
    x, y = a[i], b[j]
    err = (rate * (_labels(j) - _sigmoid((y @ x[:, :, None])[:, :, 0]))).astype(a.dtype)
    there, back = (err[:, None] @ y)[:, 0], err[:, :, None] * x[:, None]
    return [_added(a, i, there, j.shape[1]), _added(b, j.ravel(), back.reshape(-1, b.shape[1]))]


def _draws(rng: np.random.Generator, table: np.ndarray, n: int) -> np.ndarray:
    """Places drawn by their weights, of which table has the running sums: looked up in their order, which is quick, then mixed."""
    u = rng.random(n) * table[-1]
    u.sort()
    return rng.permutation(np.searchsorted(table, u, side="right"))


def _train(examples: DataFrame, places: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, ...]]], step: Callable, parts: list[np.ndarray], weight: np.ndarray, epochs: int, negatives: int, rate: float, batch: int, seed: int) -> None:
    """Moves the matrices. places: a task's examples as arrays of equal length, of which the second gets drawn ones beside it."""
    table = np.cumsum(weight)
    dimension = parts[0].shape[1]
    first_block = np.cumsum([0, *(-(-len(x) // WIDE) for x in parts)])
    sc = examples.sparkSession.sparkContext
    n_parts = max(1, min(int(first_block[-1]), 2 * sc.defaultParallelism))
    for epoch in range(epochs):
        held, now = sc.broadcast((parts, table)), rate * max(1e-4, 1 - epoch / epochs)

        def move(batches, held=held, now=now, epoch=epoch):
            first, table = held.value
            own, seen = [x.copy() for x in first], [np.zeros(len(x), np.int64) for x in first]
            rng = np.random.default_rng((seed, epoch, TaskContext.get().partitionId()))
            for given in places(batches):
                for start in range(0, len(given[0]), DRAWN * batch):
                    some = [x[start : start + DRAWN * batch] for x in given]
                    drawn = _draws(rng, table, len(some[0]) * negatives).reshape(-1, negatives)
                    some[1] = np.c_[some[1], drawn]
                    for at in range(0, len(drawn), batch):
                        for side, (rows, n) in zip(seen, step(own, *(x[at : at + batch] for x in some), now)):
                            side[rows] += n
            for side, (x, x0, n) in enumerate(zip(own, first, seen)):
                for r in range(0, len(x), WIDE):
                    at = np.flatnonzero(n[r : r + WIDE])
                    if len(at):
                        yield _block(int(first_block[side]) + r // WIDE, at, n[r + at], x[r + at] - x0[r + at])

        def mean(batches):
            sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for block, at, n, moves in _opened(batches, dimension):
                total, count = sums.setdefault(block, (np.zeros((WIDE, dimension)), np.zeros(WIDE, np.int64)))
                total[at] += moves * n[:, None]
                count[at] += n
            for block, (total, count) in sums.items():
                at = np.flatnonzero(count)
                yield _block(block, at, count[at], (total[at] / count[at, None]).astype(np.float32))

        moves = examples.mapInArrow(move, MOVES).repartitionById(n_parts, (F.col("block") % n_parts).cast("int"))
        for row in moves.mapInArrow(mean, MOVES).toLocalIterator(prefetchPartitions=True):
            at, own = _rows(row.at, row.move, dimension)
            side = int(np.searchsorted(first_block, row.block, "right")) - 1
            parts[side][at + (row.block - first_block[side]) * WIDE] += own
        held.unpersist()


MOVES = "block int, at binary, n binary, move binary"


def _block(block: int, at: np.ndarray, n: np.ndarray, move: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype("<i4"), n.astype("<i8"), move.astype("<f4")))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "at", "n", "move"])


def _rows(at: bytes, move: bytes, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(move, "<f4").reshape(-1, dimension)


def _opened(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple]:
    for batch in batches:
        for i in range(len(batch)):
            block, at, n, move = (batch.column(c)[i].as_py() for c in range(4))
            at, move = _rows(at, move, dimension)
            yield block, at, np.frombuffer(n, "<i8"), move


def _columns(*names: str) -> Callable:
    """Examples that are rows of numbers."""
    def read(batches):
        for batch in batches:
            yield tuple(batch.column(c).to_numpy() for c in names)

    return read


def _spread(examples: DataFrame, label: str) -> DataFrame:
    """Examples written in no more parts than there are cores: each part's task copies the matrices."""
    found = written(examples, label)
    n = max(1, min(found.sparkSession.sparkContext.defaultParallelism, found.count() // LEAST))
    return written(found.repartition(n), label)


def _places(values: DataFrame) -> tuple[pa.Array, DataFrame]:
    """Sorted names and (name, at)."""
    if values.count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} vectors to train")
    names = _sorted(values.toArrow().column(0).combine_chunks())
    return names, _table(values.sparkSession, names, {"at": np.arange(len(names))}, "at long", "name")


def _sorted(names: pa.Array) -> pa.Array:
    return names.take(pa.array(np.argsort(np.array(names.to_pylist(), object), kind="stable"))) if len(names) else names


def _table(spark: SparkSession, names: pa.Array, columns: dict[str, np.ndarray], kinds: str, name: str = "object") -> DataFrame:
    """Rows of the driver as a table: tasks take them from what is broadcast."""
    held = spark.sparkContext.broadcast((names.cast(pa.string()), columns))

    def rows(batches):
        for batch in batches:
            every = batch.column(0).to_numpy()
            for i in range(0, len(every), WIDE):
                k = every[i : i + WIDE]
                names, columns = held.value
                own = [x[k] for x in columns.values()]
                flat = [pa.array(x) if x.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.float64))) for x in own]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(k)), *flat], names=[name, *columns])

    return spark.range(0, len(names), 1, max(1, len(names) // 100_000)).mapInArrow(rows, f"{name} string, {kinds}")


def _word_matrices(n: int, dimension: int, seed: int) -> list[np.ndarray]:
    a = np.random.default_rng(seed).uniform(-0.5, 0.5, (n, dimension)) / dimension
    return [a.astype(np.float32), np.zeros((n, dimension), np.float32)]


def skip_gram(pairs: DataFrame, vocabulary: DataFrame, dimension: int = 32, epochs: int = 2, negatives: int = 5, rate: float = 0.05, batch: int = 256, seed: int = 1) -> DataFrame:
    """(object, vec) from window pairs (term, other) with negative sampling."""
    names, at = _places(vocabulary.select("term"))
    gf = {r.term: r.gf for r in vocabulary.select("term", "gf").toLocalIterator()}
    known = pairs.join(at.withColumnRenamed("at", "i"), F.col("term") == F.col("name")).drop("name").join(at.withColumnRenamed("at", "j"), F.col("other") == F.col("name"))
    parts = _word_matrices(len(names), dimension, seed)
    _train(_spread(known.select("i", "j"), "pairs"), _columns("i", "j"), _step, parts, np.sqrt([gf[n] for n in names.to_pylist()]), epochs, negatives, rate, batch, seed)
    return _table(pairs.sparkSession, names, {"vec": parts[0]}, "vec array<double>")


def neighbours(codes: np.ndarray, doc: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): each word with those of its document up to a radius from it, in the order of the text."""
    offsets = [o for o in range(-radius, radius + 1) if o]
    j = np.full((len(codes), len(offsets)), -1, np.int64)
    for c, o in enumerate(offsets):
        here, there = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
        j[here, c] = np.where(doc[here] == doc[there], codes[there], -1)
    row, c = np.nonzero(j >= 0)
    return codes[row], j[row, c]


def skip_gram_of_documents(docs: DataFrame, vocabulary: slabs.Vocabulary, radius: int, dimension: int = 32, epochs: int = 2, negatives: int = 5, rate: float = 0.05, batch: int = 256, seed: int = 1) -> DataFrame:
    """skip_gram() of the window pairs of documents of which no id is repeated.

    The words that the vocabulary keeps are written once as numbers; an epoch makes their
    pairs where it reads them, so that no pair is joined, sorted or written.
    """
    size = len(vocabulary.words)
    if size > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} vectors to train")
    order = np.argsort(np.array(vocabulary.words.to_pylist(), object), kind="stable") if size else np.zeros(0, np.int64)
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((vocabulary, rank))

    def coded(batches):
        vocabulary, rank = known.value
        for _, at, tokens in slabs.slabs(batches):
            code, doc = vocabulary.codes(tokens), np.repeat(np.arange(len(at) - 1), np.diff(at))
            kept = code >= 0
            code, doc = rank[code[kept]], doc[kept]
            # whole documents, so many tokens a row
            cuts = np.searchsorted(doc, doc[np.arange(TOKENS, len(doc), TOKENS)])
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(doc)]):
                if b > a:
                    lengths = np.diff(np.flatnonzero(np.r_[True, doc[a + 1 : b] != doc[a : b - 1], True]))
                    yield pa.RecordBatch.from_arrays([pa.array([code[a:b].astype("<i4").tobytes()], pa.binary()), pa.array([lengths.astype("<i4").tobytes()], pa.binary())], names=["codes", "lengths"])

    def read(batches):
        for packed in batches:
            for i in range(len(packed)):
                codes, lengths = (np.frombuffer(packed.column(c)[i].as_py(), "<i4").astype(np.int64) for c in range(2))
                yield neighbours(codes, np.repeat(np.arange(len(lengths)), lengths), radius)

    rows = slabs.worded(docs).mapInArrow(slabs.tidy(coded), "codes binary, lengths binary")
    n = max(1, min(spark.sparkContext.defaultParallelism, int(vocabulary.gf.sum()) * 2 * radius // LEAST)) if size else 1
    parts = _word_matrices(size, dimension, seed)
    if size:
        _train(written(rows.repartition(n), "words"), read, _step, parts, np.sqrt(vocabulary.gf[order]), epochs, negatives, rate, batch, seed)
    return _table(spark, vocabulary.words.take(pa.array(order)), {"vec": parts[0]}, "vec array<double>")


def _convolved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Circular convolution, row by row."""
    return np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), a.shape[1])


def _released(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Circular correlation: what b bound with it would make a."""
    return np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), a.shape[1])


#: The greatest length of a vector of S, E and P: products of three would run away.
LENGTHS = (6.0, 2.0, 1.5)


def _bounded(m: np.ndarray, rows: np.ndarray, most: float) -> None:
    own = m[rows]
    m[rows] = own * np.minimum(1, most / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)).astype(m.dtype)


def bound_step(s: np.ndarray, e: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray, label: np.ndarray, rate: float, move_predicates: bool = True) -> Touched:
    """S(i) toward (label 1) or from P(k) * E(j), E(j) with S(i) released from P(k), P(k) with S(i) released from E(j); from a snapshot. Lengths stay bounded.

    i and k have a place for each row of j and label, which may hold several of the same
    subject and predicate: convolution is linear, so that these share it.
    """
    j, label = j.reshape(len(i), -1), label.reshape(len(i), -1)
    x, y, z = s[i], e[j], p[k]
    free = _released(x, z).astype(s.dtype)  # x . (z * y) is (x released from z) . y
    err = (rate * (label - _sigmoid((y @ free[:, :, None])[:, :, 0]))).astype(s.dtype)
    pull = (err[:, None] @ y)[:, 0]
    touched = [
        _added(s, i, _convolved(z, pull).astype(s.dtype), j.shape[1]),
        _added(e, j.ravel(), (err[:, :, None] * free[:, None]).reshape(-1, e.shape[1])),
        # a batch is full of each predicate: they move by the mean
        _added(p, k, _released(x, pull).astype(p.dtype) if move_predicates else np.zeros_like(z), j.shape[1], 1.0),
    ]
    for m, (rows, _), most in zip((s, e, p), touched, LENGTHS):
        _bounded(m, rows, most)
    return touched


def predication_embeddings(triples: DataFrame, dimension: int = 32, epochs: int = 6, negatives: int = 5, rate: float = 0.5, batch: int = 256, seed: int = 2) -> DataFrame:
    """(object, vec): semantic vectors S, trained with elemental vectors E and predicate vectors P.

    For every (s, p, o), S(s) moves toward P(p) * E(o) and away from P(p) * E of drawn
    objects, * being circular convolution; E and P move with it. The inverse
    (o, p-INV, s) is trained alike. An object has one E under all predicates, a
    predicate one P under all objects.
    """
    both = triples.select("subject", "predicate", "object").unionByName(triples.select(F.col("object").alias("subject"), F.concat("predicate", F.lit("-INV")).alias("predicate"), F.col("subject").alias("object")))
    both = written(both.where("subject is not null and predicate is not null and object is not null"), "triples")
    # every name is the object of some triple or of its inverse
    counted = written(both.groupBy("object").count(), "names")
    names, at = _places(counted.select(F.col("object").alias("term")))
    kinds, kind = _places(both.select("predicate").distinct())
    known = both.join(F.broadcast(kind), F.col("predicate") == F.col("name")).drop("name").withColumnRenamed("at", "k")
    for column, place in (("subject", "i"), ("object", "j")):
        known = known.join(at.withColumnRenamed("at", place), F.col(column) == F.col("name")).drop("name")
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, scale / np.sqrt(dimension), (n, dimension)).astype(np.float32) for scale, n in ((0.5, len(names)), (1, len(names)), (1, len(kinds)))]
    for m, most in zip(parts, LENGTHS):
        _bounded(m, np.arange(len(m)), most)
    rows = counted.join(at, F.col("object") == F.col("name")).select("at", "count").toArrow()
    weight = np.zeros(len(names))
    weight[rows.column("at").to_numpy()] = rows.column("count").to_numpy() ** 0.75

    def step(own, i, j, k, now):
        return bound_step(*own, i, j, k, _labels(j), now)

    if len(names):
        _train(_spread(known.select("i", "j", "k"), "examples"), _columns("i", "j", "k"), step, parts, weight, epochs, negatives, rate, batch, seed)
    return _table(triples.sparkSession, names, {"vec": parts[0]}, "vec array<double>")
