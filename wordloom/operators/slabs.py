"""Documents as numbers: words by their place in a vocabulary, counted in slabs and sent as sorted, packed keys.

A slab is a run of whole documents. What is counted in it (pairs of neighbours) is one
sorted array of integers; their differences, byte by byte and compressed, take about two
bytes a key in the shuffle, where a row of two words takes some forty. A bucket of keys
is merged by one task; the number of buckets grows with the corpus, so that a task's
memory does not.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Tokens of a slab, about; a longer document is a slab of its own.
TOKENS = 800_000
#: Documents that go to a Python worker at once, at most.
BATCH_ROWS = 2000
#: Keys that a bucket gets, about.
KEYS = 1_000_000
#: A larger vocabulary is not held by every task: the callers join instead.
MOST_TERMS = 1 << 23
#: Low bits of a key, below its bucket.
BITS = 50
#: Rows of a batch that goes back to Spark.
ROWS = 50_000


def unrepeated(docs: DataFrame) -> bool:
    """Whether no doc_id occurs twice or is null, so that a row is a document."""
    return docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def release() -> None:
    """Gives memory that a worker has let go back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function over a task's batches that releases memory as it goes and when it ends."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, out in enumerate(run(batches)):
            yield out
            if k % 4 == 3:
                del out
                release()
        release()

    return wrapped


def worded(docs: DataFrame, doc: Column | None = None) -> DataFrame:
    """(doc, words): the id as text, or what else stands for a document, and the tokens in their order; batches are kept small."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    doc = F.col("doc_id").cast("string") if doc is None else doc
    return docs.select(doc.alias("doc"), T.words(F.col("text")).alias("words"))


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """(ids, offsets from 0, tokens) of runs of whole documents."""
    for batch in batches:
        lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
        at = lists.offsets.to_numpy().astype(np.int64)
        row = 0
        while row < len(lists):
            end = max(row + 1, int(np.searchsorted(at, at[row] + TOKENS, "right")) - 1)
            yield batch.column(0).slice(row, end - row), at[row : end + 1] - at[row], lists.values.slice(at[row], at[end] - at[row])
            row = end


def counts(docs: DataFrame) -> DataFrame:
    """(term, gf, df) of documents of which no id is repeated: counted slab by slab."""
    def counted(batches):
        for _, at, tokens in slabs(batches):
            coded = tokens.dictionary_encode()
            code, n = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            df = np.bincount(np.unique(doc * n + code) % n, minlength=n)[: len(coded.dictionary)]
            gf = np.bincount(code, minlength=n)[: len(coded.dictionary)]
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(gf), pa.array(df)], names=["term", "gf", "df"])

    parts = worded(docs).mapInArrow(tidy(counted), "term string, gf long, df long")
    return parts.groupBy("term").agg(F.sum("gf").alias("gf"), F.sum("df").alias("df"))


@dataclass
class Vocabulary:
    """Words by number, their weights and the places of their elemental vectors."""

    words: pa.Array
    gf: np.ndarray
    weight: np.ndarray
    places: np.ndarray

    def codes(self, tokens: pa.Array) -> np.ndarray:
        """Each token's number; -1 for one that is left out."""
        coded = tokens.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return known[coded.indices.to_numpy()] if len(tokens) else np.zeros(0, np.int64)


def vocabulary(counted: DataFrame, weight: Column, places: Column) -> Vocabulary:
    """The table of (term, gf, ..) on the driver, from where it is broadcast."""
    t = counted.select("term", "gf", weight.cast("double").alias("weight"), places.alias("places")).toArrow().combine_chunks()
    column = lambda c: t.column(c).combine_chunks() if len(t) else pa.array([], t.schema.field(c).type)
    words = column("term")
    return Vocabulary(words, column("gf").to_numpy(), column("weight").to_numpy(), column("places").flatten().to_numpy().astype(np.uint16).reshape(len(words), -1))


# packed keys


def packed(values: np.ndarray) -> bytes:
    """Integers byte by byte, compressed: high bytes are zeros and cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n).astype(np.int64)


def runs(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in their order, and how often each occurs (or the sum of its n)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)]) if n is None else np.add.reduceat(n, first) if len(first) else n


BLOCK = "bucket int, size int, keys binary, counts binary"


def blocks(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A slab's keys (bucket in the high bits) as one packed row a bucket."""
    keys, n = runs(keys)
    bucket = keys >> BITS
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    rows = [(int(bucket[a]), int(b - a), packed(np.diff(keys[a:b] & ((1 << BITS) - 1), prepend=0)), packed(n[a:b])) for a, b in zip(at[:-1], at[1:])]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "size", "keys", "counts"])


def opened(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, keys, counts) of a task's rows, some `most` keys at once."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, size, keys, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            own = held.setdefault(bucket, [])
            own.append((np.cumsum(unpacked(keys, size)), unpacked(n, size)))
            if sum(len(k) for k, _ in own) >= most:
                yield bucket, *(np.concatenate(x) for x in zip(*own))
                held[bucket] = []
    for bucket, own in held.items():
        if own:
            yield bucket, *(np.concatenate(x) for x in zip(*own))


# windows


def neighbours(vocabulary: Vocabulary, ids: pa.Array, at: np.ndarray, tokens: pa.Array, radius: int, exact: bool, random: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """(left, right, offset, whether left has right in its window, whether right has left) for each offset."""
    code = vocabulary.codes(tokens)
    doc, pos = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.arange(len(code)) - np.repeat(at[:-1], np.diff(at))
    if not exact:
        kept = code >= 0
        code, doc, pos = code[kept], doc[kept], pos[kept]
    own = np.full(len(code), radius)
    if random:
        names, md5 = [x.encode() for x in ids.to_pylist()], hashlib.md5
        own = 1 + np.fromiter((int.from_bytes(md5(b"%b#%d" % (names[d], p)).digest()[:4], "big") for d, p in zip(doc, pos)), np.int64, len(code)) % radius
    for o in range(1, radius + 1):
        a, b = code[:-o], code[o:]
        there = (doc[:-o] == doc[o:]) & (a >= 0) & (b >= 0)
        yield a[there], b[there], o, own[:-o][there] >= o, own[o:][there] >= o


def window_counts(docs: DataFrame, vocabulary: Vocabulary, radius: int, exact: bool = False, random: bool = False) -> DataFrame:
    """(term, other, offset, n): how often other stands at an offset from term; corpus.window_pairs() counted.

    A pair is counted once, from its left word, and turned round where it is written out.
    """
    size, sides = len(vocabulary.words), 2 if random else 1
    n_buckets = max(1, min(1 << 12, int(vocabulary.gf.sum()) * radius * sides // KEYS))
    if size * size * radius * 2 >= 1 << BITS:
        raise ValueError("the vocabulary is too large for keys")
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def paired(batches):
        for ids, at, tokens in slabs(batches):
            keys = []
            for a, b, o, there, back in neighbours(held.value, ids, at, tokens, radius, exact, random):
                key = ((a * size + b) * radius + o - 1) * 2 + ((a * 40503 + b) % n_buckets << BITS)
                keys += [key[there], key[back] + 1] if random else [key]
            yield from blocks(np.concatenate(keys))
            release()

    def merged(batches):
        got: dict[int, tuple] = {}
        for bucket, keys, n in opened(batches):
            if bucket in got:
                keys, n = np.r_[got[bucket][0], keys], np.r_[got[bucket][1], n]
            got[bucket] = runs(keys, n)
        words = held.value.words
        for keys, n in got.values():
            for i in range(0, len(keys), ROWS):
                k, m = keys[i : i + ROWS], n[i : i + ROWS]
                back, o, pair = k & 1, (k >> 1) % radius + 1, (k >> 1) // radius
                a, b = pair // size, pair % size
                ways = [(np.where(back, b, a), np.where(back, a, b), np.where(back, -o, o))] if random else [(a, b, o), (b, a, -o)]
                for x, y, offset in ways:
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(x)), words.take(pa.array(y)), pa.array(offset.astype(np.int32)), pa.array(m)], names=["term", "other", "offset", "n"])

    sent = worded(docs).mapInArrow(tidy(paired), BLOCK).repartitionById(n_buckets, F.col("bucket"))
    return sent.mapInArrow(tidy(merged), "term string, other string, offset int, n long")


def positional(docs: DataFrame, vocabulary: Vocabulary, dimension: int, radius: int, permutations: dict[int, list[np.ndarray]]) -> DataFrame:
    """(object, dim, val): normalised sums of the neighbours' weights times their elemental vectors, moved by an offset's permutations.

    permutations: by offset; offsets that share the same ones are counted together.
    """
    size, seed = len(vocabulary.words), vocabulary.places.shape[1] if len(vocabulary.words) else 1
    kinds: list[list[np.ndarray]] = []
    kind = {}
    for o, ps in permutations.items():
        same = [i for i, k in enumerate(kinds) if len(k) == len(ps) and all((x == y).all() for x, y in zip(k, ps))]
        kind[o] = same[0] if same else len(kinds)
        if not same:
            kinds.append(ps)
    n_buckets = max(1, min(1 << 12, size, int(vocabulary.gf.sum()) * radius * 2 // KEYS))
    wide = -(-size // n_buckets) if size else 1
    if size * size * len(kinds) >= 1 << BITS:
        raise ValueError("the vocabulary is too large for keys")
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def paired(batches):
        for ids, at, tokens in slabs(batches):
            keys = []
            for a, b, o, _, _ in neighbours(held.value, ids, at, tokens, radius, False, False):
                for x, y, t in ((a, b, kind[o]), (b, a, kind[-o])):
                    keys.append((x * size + y) * len(kinds) + t + (x // wide << BITS))
            yield from blocks(np.concatenate(keys))

    def placed(batches):
        v = held.value
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for bucket, keys, n in opened(batches):
            if bucket not in sums:
                sums[bucket] = np.zeros(wide * dimension), np.zeros(wide * dimension, bool)
            val, seen = sums[bucket]
            t, pair = keys % len(kinds), keys // len(kinds)
            x, y = pair // size - bucket * wide, pair % size
            w = n * v.weight[y]
            for t_, ps in enumerate(kinds):
                own = t == t_
                x_, y_, w_ = x[own] * dimension, y[own], w[own]
                for p in ps:
                    for k in range(seed):
                        to = x_ + p[v.places[y_, k]]
                        val += np.bincount(to, w_ if k < seed // 2 else -w_, minlength=len(val))
                        seen[to] = True
        for bucket, (val, seen) in sums.items():
            m = val.reshape(wide, dimension)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0).ravel()
            at = np.flatnonzero(seen)
            for i in range(0, len(at), ROWS):
                k = at[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([v.words.take(pa.array(k // dimension + bucket * wide)), pa.array((k % dimension).astype(np.int32)), pa.array(m[k])], names=["object", "dim", "val"])

    sent = worded(docs).mapInArrow(tidy(paired), BLOCK).repartitionById(n_buckets, F.col("bucket"))
    return sent.mapInArrow(tidy(placed), "object string, dim int, val double")


def elemental(spark: SparkSession, vocabulary: Vocabulary, dimension: int) -> DataFrame:
    """(object, i, val): every word's elemental vector, zeros included."""
    size, seed = len(vocabulary.words), vocabulary.places.shape[1] if len(vocabulary.words) else 1
    held = spark.sparkContext.broadcast(vocabulary)

    def filled(batches):
        for batch in batches:
            every = batch.column(0).to_numpy()
            for at in range(0, len(every), 1000):
                k = every[at : at + 1000]
                to = (np.arange(len(k))[:, None] * dimension + held.value.places[k]).ravel()
                val = np.bincount(to, np.tile(np.where(np.arange(seed) < seed // 2, 1.0, -1.0), len(k)), len(k) * dimension)
                yield pa.RecordBatch.from_arrays([held.value.words.take(pa.array(np.repeat(k, dimension))), pa.array(np.tile(np.arange(dimension, dtype=np.int32), len(k))), pa.array(val + 0.0)], names=["object", "i", "val"])

    return spark.range(0, size, 1, max(1, size // 20_000)).mapInArrow(tidy(filled), "object string, i int, val double")
