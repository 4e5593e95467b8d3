"""Term and document vectors as products with the corpus matrix, which is counted once in slabs of whole documents.

A slab's postings (term, document, tf) are sorted by term and packed in ranges of terms.
A document's vector is worked out where the document is, and written beside its slab in
slices of a few dimensions. The terms' sums over documents are made slice by slice: a
task reads its slice of all slabs, so that what is shuffled is the terms' matrix, not
the postings' vectors. Between two steps this matrix goes over the driver to every task,
packed, up to `MOST_TERMS` terms.

A vector has its values and a mask of the places that are there: a place whose parts
cancel is there with 0, and one that nothing was added to is not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import slabs
from .models import Space

#: Terms of a range.
WIDE = 8192
#: Dimensions that a task sums at once.
SLICE = 8
#: A larger matrix is not held by every task: the callers join instead.
MOST_TERMS = 1 << 21
#: Postings that are multiplied at once.
CHUNK = 1 << 15
#: Rows of a batch that goes back to Spark.
ROWS = 50_000


@dataclass
class Index:
    """The packed slabs (docs, n, blocks), the vocabulary, which is also sent to the tasks, and the type of doc_id."""

    slabs: DataFrame
    vocabulary: slabs.Vocabulary
    held: Broadcast
    key: str


@dataclass
class Matrix:
    """A row for each term."""

    val: np.ndarray
    there: np.ndarray


def packed(*columns: np.ndarray) -> bytes:
    """Integers below 2 ** 32, byte by byte, compressed."""
    planes = np.ascontiguousarray(np.concatenate(columns).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * columns * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(columns, n).astype(np.int64)


def index(docs: DataFrame, vocabulary: slabs.Vocabulary) -> Index:
    """The corpus matrix of documents of which no id is repeated."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches):
        edges = np.arange(0, len(held.value.words) + WIDE, WIDE)
        for ids, at, tokens in slabs.slabs(batches):
            code, doc = held.value.codes(tokens), np.repeat(np.arange(len(at) - 1), np.diff(at))
            kept = code >= 0
            keys, tf = slabs.runs(code[kept] * len(ids) + doc[kept])
            term, doc = keys // len(ids), keys % len(ids)
            cut = np.searchsorted(term, edges)
            blocks = [packed(np.diff(term[a:b], prepend=edge), doc[a:b], tf[a:b]) for a, b, edge in zip(cut[:-1], cut[1:], edges)]
            yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.string())), pa.array([np.diff(cut)], pa.list_(pa.int32())), pa.array([blocks], pa.list_(pa.binary()))], names=["docs", "n", "blocks"])

    # many small files: the slabs are cheap to read, but dear to work out
    spread = max(1, min(4 * docs.sparkSession.sparkContext.defaultParallelism, int(vocabulary.gf.sum()) // slabs.TOKENS))
    found = slabs.worded(docs).mapInArrow(slabs.tidy(counted), "docs array<string>, n array<int>, blocks array<binary>")
    return Index(written(found.repartition(spread), "postings"), vocabulary, held, docs.schema["doc_id"].dataType.simpleString())


class Slab:
    def __init__(self, docs: list[str], n: list[int], blocks: list[bytes]):
        self.docs, self.n, self.blocks = docs, n, blocks

    def part(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms, documents, tf) of a range, by term."""
        term, doc, tf = unpacked(self.blocks[r], 3, self.n[r])
        return np.cumsum(term) + r * WIDE, doc, tf

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [self.part(r) for r in range(len(self.n))]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Slab]:
    for batch in batches:
        for i in range(len(batch)):
            yield Slab(*(batch.column(c)[i].as_py() for c in range(3)))


def add(val: np.ndarray, there: np.ndarray, to: np.ndarray, of: np.ndarray, w: np.ndarray, m: Matrix) -> None:
    """To rows `to`, which are sorted, w times the rows `of` of a matrix."""
    for i in range(0, len(to), CHUNK):
        t, rows = to[i : i + CHUNK], of[i : i + CHUNK]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        val[t[first]] += np.add.reduceat(m.val[rows] * w[i : i + CHUNK, None], first, axis=0)
        there[t[first]] |= np.bitwise_or.reduceat(m.there[rows], first)


def add_rows(val: np.ndarray, to: np.ndarray, of: np.ndarray, w: np.ndarray, m: np.ndarray) -> None:
    """The same where every place is there; chunks stay in a core's cache."""
    few = CHUNK // 4
    for i in range(0, len(to), few):
        t = to[i : i + few]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        rows = np.take(m, of[i : i + few], axis=0, mode="clip")
        rows *= w[i : i + few, None]
        val[t[first]] += np.add.reduceat(rows, first, axis=0)


def scattered(n: int, to: np.ndarray, places: np.ndarray, w: np.ndarray, dimension: int) -> Matrix:
    """n rows: w times the elemental vectors of these places, added to rows `to`."""
    val, there = np.zeros(n * dimension), np.zeros(n * dimension, bool)
    for k in range(places.shape[1]):
        at = to * dimension + places[:, k]
        val += np.bincount(at, w if k < places.shape[1] // 2 else -w, n * dimension)
        there[at] = True
    return Matrix(val.reshape(n, dimension), masks(there.reshape(n, dimension)))


def masks(there: np.ndarray) -> np.ndarray:
    """Rows of booleans as bits of a word."""
    return (there.astype(np.uint64) << np.arange(there.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def places_there(mask: np.ndarray, dimension: int) -> np.ndarray:
    return (mask[:, None] >> np.arange(dimension, dtype=np.uint64) & np.uint64(1)).astype(bool)


def unit(val: np.ndarray) -> np.ndarray:
    norm = np.sqrt((val * val).sum(axis=1, keepdims=True))
    return np.divide(val, norm, out=np.zeros_like(val), where=norm > 0)


LOCAL = {"tf": lambda tf: tf.astype(np.float64), "log": lambda tf: np.log10(1.0 + tf)}


@dataclass
class Documents:
    """How a document's vector comes about.

    elemental: its own elemental vector; seeded: the sum of its terms' elemental vectors,
    each times local and global weight; terms: the same of the rows of a matrix; symmetric:
    as seeded, its weights having length 1.
    """

    kind: str
    space: Space
    local: str = "tf"

    def weights(self, slab: Slab, vocabulary: slabs.Vocabulary, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return LOCAL[self.local](tf) * vocabulary.weight[term]

    def vectors(self, slab: Slab, vocabulary: slabs.Vocabulary, m: Matrix | None) -> Matrix:
        n, d = len(slab.docs), self.space.dimension
        if self.kind == "elemental":
            md5 = hashlib.md5
            at = np.array([[int.from_bytes(md5(b"%b#%d" % (x, k)).digest()[:4], "big") % d for k in range(self.space.seed)] for x in (x.encode() for x in slab.docs)], np.int64).reshape(n, -1)
            return scattered(n, np.arange(n), at, np.ones(n), d)
        term, doc, tf = slab.whole()
        w = self.weights(slab, vocabulary, term, doc, tf)
        if self.kind == "terms":
            order = np.argsort(doc, kind="stable")
            out = Matrix(np.zeros((n, d)), np.zeros(n, np.uint64))
            add(out.val, out.there, doc[order], term[order], w[order], m)
            return Matrix(unit(out.val), out.there)
        if self.kind == "symmetric":
            norm = np.sqrt(np.bincount(doc, w * w, n))
            slab.norm = np.where(norm > 0, norm, np.inf)
            return scattered(n, doc, vocabulary.places[term].astype(np.int64), w / slab.norm[doc], d)
        out = scattered(n, doc, vocabulary.places[term].astype(np.int64), w, d)
        return Matrix(unit(out.val), out.there)


BLOCK = "r int, k int, at binary, there binary, val binary"


def shrunk(val: np.ndarray) -> bytes:
    """Values byte by byte: sums of whole numbers are mostly zeros."""
    return pa.compress(np.ascontiguousarray(val.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def grown(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.float64).reshape(n)


def block(r: int, k: int, at: np.ndarray, there: np.ndarray, val: np.ndarray) -> pa.RecordBatch:
    """Rows of a range, of one slice of the dimensions."""
    columns = [pa.array([x], pa.int32()) for x in (r, k)] + [pa.array([x], pa.binary()) for x in (at.astype("<i4").tobytes(), there[at].tobytes(), shrunk(np.ascontiguousarray(val[at])))]
    return pa.RecordBatch.from_arrays(columns, names=["r", "k", "at", "there", "val"])


def block_rows(at: bytes, there: bytes, val: bytes, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.frombuffer(at, "<i4")
    return at, np.frombuffer(there, np.uint64), grown(val, len(at) * dimension).reshape(len(at), dimension)


@dataclass
class Packed:
    """Sums of terms as they were sent; a worker opens and normalises them once."""

    blocks: list[tuple]
    size: int
    dimension: int
    opened: Matrix | None = None

    def matrix(self) -> Matrix:
        if self.opened is None:
            m = Matrix(np.zeros((self.size, self.dimension)), np.zeros(self.size, np.uint64))
            for r, at, there, val in self.blocks:
                at, mask, own = block_rows(at, there, val, self.dimension)
                m.val[at + r * WIDE], m.there[at + r * WIDE] = unit(own), mask
            self.opened = m
        return self.opened


def _placed(ix: Index, how: Documents, m: Packed | None) -> DataFrame:
    """The slabs with their documents' vectors, in columns of a few dimensions each, written."""
    d = how.space.dimension
    n_slices = -(-d // SLICE)
    held, vocabulary = ix.slabs.sparkSession.sparkContext.broadcast(m), ix.held

    def each(batches):
        for slab in opened(batches):
            x = how.vectors(slab, vocabulary.value, held.value and held.value.matrix())
            vecs = [[shrunk(np.ascontiguousarray(x.val[:, k * SLICE : (k + 1) * SLICE]))] for k in range(n_slices)]
            norm = slab.norm.tobytes() if how.kind == "symmetric" else b""
            own = [pa.array([slab.n], pa.list_(pa.int32())), pa.array([slab.blocks], pa.list_(pa.binary())), pa.array([x.there.tobytes()], pa.binary()), pa.array([norm], pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, pa.binary()) for v in vecs)], names=["n", "blocks", "there", "norm", *(f"s{k}" for k in range(n_slices))])

    schema = "n array<int>, blocks array<binary>, there binary, norm binary, " + ", ".join(f"s{k} binary" for k in range(n_slices))
    return written(ix.slabs.mapInArrow(slabs.tidy(each), schema), "placed")


def _sums(ix: Index, how: Documents, m: Packed | None, local: str) -> tuple[DataFrame, int]:
    """The terms' sums in ranges: a task takes a few dimensions of all slabs, or of one part of them where there are more cores."""
    spark, d = ix.slabs.sparkSession, how.space.dimension
    held = ix.held
    n_ranges, n_slices = -(-len(ix.vocabulary.words) // WIDE), -(-d // SLICE)

    def sent(vocabulary, k, val, mask, own):
        for r in range(n_ranges):
            some = slice(r * WIDE, min(len(val), (r + 1) * WIDE))
            if how.kind == "symmetric":  # less what a term gets from itself
                n = some.stop - some.start
                val[some] -= scattered(n, np.arange(n), vocabulary.places[some].astype(np.int64), own[some], d).val[:, k * SLICE : (k + 1) * SLICE]
            at = np.flatnonzero(mask[some])
            if len(at):
                yield block(r, k, at, mask[some], val[some])

    def summed(batches):
        vocabulary, now, sums = held.value, None, ()
        size = len(vocabulary.words)
        for batch in batches:
            for i in range(len(batch)):
                k, n, blocks, there, norm, vec = (batch.column(c)[i].as_py() for c in range(6))
                there, norm = np.frombuffer(there, np.uint64), np.frombuffer(norm)
                wide = min(SLICE, d - k * SLICE)
                if k != now:
                    if now is not None:
                        yield from sent(vocabulary, now, *sums)
                    now, sums = k, (np.zeros((size, wide)), np.zeros(size, np.uint64), np.zeros(size))
                val, mask, own = sums
                x, slab = Matrix(grown(vec, len(there) * wide).reshape(len(there), wide), there), Slab([], n, blocks)
                for r in range(len(n)):
                    term, doc, tf = slab.part(r)
                    w = LOCAL[local](tf)
                    if how.kind == "symmetric":
                        w = how.weights(slab, vocabulary, term, doc, tf) / norm[doc]
                        own[r * WIDE : (r + 1) * WIDE] += np.bincount(term - r * WIDE, w * w, min(WIDE, size - r * WIDE))
                    add(val, mask, term, doc, w, x)
        if now is not None:
            yield from sent(vocabulary, now, *sums)

    placed = _placed(ix, how, m)
    # two at least: a union of single partitions would be one task
    parts = max(2, -(-spark.sparkContext.defaultParallelism // n_slices))
    each = [placed.select(F.lit(k).alias("k"), "n", "blocks", "there", "norm", F.col(f"s{k}").alias("vec")).coalesce(parts) for k in range(n_slices)]
    every = each[0]
    for x in each[1:]:
        every = every.unionAll(x)
    return every.mapInArrow(slabs.tidy(summed), BLOCK), n_ranges


def _merged(ix: Index, how: Documents, m: Packed | None, local: str, out: Callable, schema: str) -> DataFrame:
    """out(r, places of terms, masks, values) of every range."""
    d = how.space.dimension
    sums, n_ranges = _sums(ix, how, m, local)

    def merged(batches):
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(len(batch)):
                r, k, *rest = (batch.column(c)[i].as_py() for c in range(5))
                val, there = ranges.setdefault(r, (np.zeros((WIDE, d)), np.zeros(WIDE, np.uint64)))
                at, mask, own = block_rows(*rest, min(SLICE, d - k * SLICE))
                val[at, k * SLICE : (k + 1) * SLICE] += own
                there[at] |= mask
        for r, (val, there) in ranges.items():
            yield from out(r, np.flatnonzero(there), there, val)

    return sums.repartitionById(max(1, n_ranges), F.col("r")).mapInArrow(slabs.tidy(merged), schema)


def _long(names: pa.Array, there: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    row, dim = np.nonzero(there)
    for i in range(0, len(row), ROWS):
        r, k = row[i : i + ROWS], dim[i : i + ROWS]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(r)), pa.array(k.astype(np.int32)), *(pa.array(x[r, k]) for x in columns.values())], names=["object", "dim", *columns])


def terms(ix: Index, how: Documents, m: Packed | None = None, local: str = "tf") -> DataFrame:
    """(object, dim, val): normalised sums of the documents' vectors, each times the local weight."""
    held, d = ix.held, how.space.dimension

    def out(r, at, there, val):
        yield from _long(held.value.words.take(pa.array(at + r * WIDE)), places_there(there[at], d), {"val": unit(val[at])})

    return _merged(ix, how, m, local, out, "object string, dim int, val double")


def term_signs(ix: Index, how: Documents) -> DataFrame:
    """(object, dim, bit): models.signs() of the sums."""
    held, d = ix.held, how.space.dimension

    def out(r, at, there, val):
        known, val = places_there(there[at], d), val[at]
        tie = np.cumsum(known & (val == 0), axis=1)
        bit = np.where(val > 0, 1, np.where(val < 0, 0, (tie + 1) % 2)).astype(np.int32)
        yield from _long(held.value.words.take(pa.array(at + r * WIDE)), known, {"bit": bit})

    return _merged(ix, how, None, "tf", out, "object string, dim int, bit int")


def _dense(names: pa.Array, val: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(val) + 1, dtype=np.int32) * val.shape[1]), pa.array(val.ravel()))
    return pa.RecordBatch.from_arrays([names, flat, *map(pa.array, more.values())], names=["object", "vec", *more])


def term_store(ix: Index, how: Documents) -> DataFrame:
    """(object, vec, weight) of the same, 0 where nothing is."""
    held = ix.held

    def out(r, at, there, val):
        yield _dense(held.value.words.take(pa.array(at + r * WIDE)), unit(val[at]), weight=held.value.weight[at + r * WIDE])

    return _merged(ix, how, None, "tf", out, "object string, vec array<double>, weight double")


def term_matrix(ix: Index, how: Documents) -> Packed:
    """The sums on the driver, packed: of elemental vectors they are whole numbers and take a fraction of the matrix."""
    def out(r, at, there, val):
        yield block(r, 0, at, there, val)

    rows = written(_merged(ix, how, None, "tf", out, BLOCK), "terms").toLocalIterator()
    return Packed([(x.r, bytes(x.at), bytes(x.there), bytes(x.val)) for x in rows], len(ix.vocabulary.words), how.space.dimension)


def _by_document(ix: Index, how: Documents, m: Packed | None, out: Callable, schema: str) -> DataFrame:
    """out(slab, its documents' vectors) of every slab."""
    held, vocabulary = ix.slabs.sparkSession.sparkContext.broadcast(m), ix.held

    def each(batches):
        for slab in opened(batches):
            yield from out(slab, how.vectors(slab, vocabulary.value, held.value and held.value.matrix()))

    return ix.slabs.mapInArrow(slabs.tidy(each), schema)


def documents(ix: Index, how: Documents, m: Packed | None) -> DataFrame:
    """(object, dim, val) of the documents."""
    d = how.space.dimension

    def out(slab, x):
        yield from _long(pa.array(slab.docs, pa.string()), places_there(x.there, d), {"val": x.val})

    return _by_document(ix, how, m, out, "object string, dim int, val double").withColumn("object", F.col("object").cast(ix.key))


def document_store(ix: Index, how: Documents, m: Packed | None) -> DataFrame:
    """(object, vec) of all documents; one without terms has the zero vector."""
    def out(slab, x):
        for i in range(0, len(slab.docs), ROWS // how.space.dimension):
            some = slice(i, i + ROWS // how.space.dimension)
            yield _dense(pa.array(slab.docs[some], pa.string()), x.val[some])

    return _by_document(ix, how, m, out, "object string, vec array<double>").withColumn("object", F.col("object").cast(ix.key))


def document_products(ix: Index, how: Documents, m: Packed | None, key: str) -> DataFrame:
    """(object, x): the documents' products with the vector of one of them, of those that share a place with it."""
    d = how.space.dimension
    def own(slab, x):
        k = slab.docs.index(key)
        yield pa.RecordBatch.from_arrays([pa.array([x.val[k].tolist()]), pa.array([places_there(x.there[[k]], d)[0].tolist()])], names=["vec", "there"])

    found = _by_document(replace(ix, slabs=ix.slabs.where(F.array_contains("docs", key))), how, m, own, "vec array<double>, there array<boolean>").collect()
    q = np.array(found[0].vec if found else [0.0] * d)
    # a place of the query that cancels to 0 adds nothing, but makes a row a hit
    mask = masks(np.array([found[0].there]))[0] if found else np.uint64(0)

    def out(slab, x):
        near = np.flatnonzero(x.there & mask)
        yield pa.RecordBatch.from_arrays([pa.array(slab.docs, pa.string()).take(pa.array(near)), pa.array(x.val[near] @ q)], names=["object", "x"])

    return _by_document(ix, how, m, out, "object string, x double").withColumn("object", F.col("object").cast(ix.key))
