"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A document's signature has 128 bits: its lower-cased words vote on every bit, each
weighted by 1 + ln of its count, so that the frequent words which all long texts of
a language share don't decide. The signature is cut into three parts. If two
signatures differ in at most `RADIUS` bits, then by the pigeonhole principle some
part differs in no more bits than that part's own radius, and for this radius r
the 2**(r + 1) - 1 masks of the part leave out all bits of any r positions at least
once: positions get random vectors of r + 1 bits, mask v keeps the positions whose
vector has an odd product with v, and fewer than r + 1 vectors always have a common
v orthogonal to them all. So every pair within the radius meets in some table.

Such a pair is only a candidate. It becomes an edge if the texts share at least
`SHARED` of their words, counted with repeats (Jaccard of the multisets).

Groups are the components of the edges, and only what connects is looked at. Equal
word counts are one class from the start. A table's bucket of more than `CROWD`
members gives a spanning forest of its candidates instead of all pairs, so that a
bucket of any size gives no more pairs than members. Where an edge of a forest
fails on the texts, the members that candidates connect and edges so far don't
are paired again, across what is still apart.

Defined cases: a document is a row of doc_id and text, both may be null; equal rows
count as one. Documents without a word (null, empty, punctuation alone) are in no
group. Documents of equal words and counts are always in one group. Of a group, the
smallest doc_id stays (null comes last, then the least hash of id and text); a
repeated doc_id with other text is another document. Texts of any length count
whole. An empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, blocks, lean, lowered, mix64, row_key, small_side, tidy, word_hashes, word_spans, written

BITS = 128
#: Widths of the signature's parts and the radius that each part covers.
PARTS = ((43, 5), (43, 5), (42, 4))
#: Pairs that differ in at most so many bits are candidates (4 + 5 + 5 + 2).
RADIUS = sum(r for _, r in PARTS) + len(PARTS) - 1
#: Least share of common words of a near duplicate.
SHARED = 0.5
#: Members of a bucket that are all paired; more give a spanning forest.
CROWD = 32
#: Members compared at once in a crowded bucket.
TILE = 2048
#: Edges (16 bytes each) whose components the driver finds; more stay with the executors.
HELD_EDGES = 1_000_000
#: Rows of keys in one task.
KEYS = 400_000
#: Pairs of texts compared at once.
TEXTS = 256

SIGNATURE = "key long, doc_id long, hi long, lo long, digest long, n_words long"


def masks(seed: int = 7) -> list[tuple[int, int]]:
    """(hi, lo) bit masks of all tables."""
    rng = np.random.default_rng(seed)
    found, at = [], 0
    for width, radius in PARTS:
        codes = rng.integers(0, 1 << (radius + 1), width)
        for v in range(1, 1 << (radius + 1)):
            bits = sum(1 << (at + i) for i in range(width) if int(codes[i] & v).bit_count() & 1)
            found.append((bits >> 64, bits & ((1 << 64) - 1)))
        at += width
    return found


def _vote(hashes: np.ndarray, weights: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros((n, BITS), np.float32)
    for at in range(0, len(hashes), 8192):
        h, w, r = hashes[at : at + 8192], weights[at : at + 8192], rows[at : at + 8192]
        two = np.stack([h, mix64(h + U64(0x632BE59BD9B4E019))], axis=1)
        votes = np.unpackbits(two.view(np.uint8), axis=1).astype(np.float32)
        votes *= 2
        votes -= 1
        votes *= w[:, None]
        runs = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        sums[r[runs]] += np.add.reduceat(votes, runs, axis=0)
    packed = np.packbits(sums > 0, axis=1)
    words = packed.view(">u8").astype(U64)
    return words[:, 0], words[:, 1]


def signature_block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, words, digest of the words and their counts) of each row of lower-cased text."""
    n = len(offsets) - 1
    first, last, rows = word_spans(data, offsets)
    h = word_hashes(data, first, last)
    order = np.lexsort((h, rows))
    h, r = h[order], rows[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, int)
    tf = np.diff(np.r_[new, len(h)])
    hi, lo = _vote(h[new], (1 + np.log(tf)).astype(np.float32), r[new], n)
    digest = np.zeros(n, U64)
    np.add.at(digest, r[new], mix64(h[new] ^ mix64(tf.astype(U64))))
    return hi, lo, np.bincount(rows, minlength=n), digest


def bags(column: pa.Array) -> list[np.ndarray]:
    """Each row's words as sorted 64-bit numbers, a repeat of a word having one of its own."""
    out = []
    for row, end, data, offsets in blocks(lowered(column)):
        first, last, rows = word_spans(data, offsets)
        h = word_hashes(data, first, last)
        order = np.lexsort((h, rows))
        h, r = h[order], rows[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        nth = np.arange(len(h)) - np.repeat(begin, np.diff(np.r_[begin, len(h)]))
        h = mix64(h + U64(0x9E3779B97F4A7C15) * nth.astype(U64))
        out += [np.sort(x) for x in np.split(h, np.searchsorted(r, np.arange(1, end - row)))]
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in blocks(lowered(batch.column(2))):
            hi, lo, words, digest = signature_block(data, offsets)
            own = [batch.column(k)[row:end] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.view(np.int64)) for x in (hi, lo, digest)), pa.array(words)], names=["key", "doc_id", "hi", "lo", "digest", "n_words"])


def signatures(docs: DataFrame) -> DataFrame:
    """(key, doc_id, hi, lo, digest, n_words) of every row."""
    rows = lean(docs).select(row_key(docs).alias("key"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(tidy(_signatures), SIGNATURE)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi masks, lo masks, salts)."""
    found = masks()
    return np.array([a for a, _ in found], U64), np.array([b for _, b in found], U64), np.arange(len(found), dtype=U64) * U64(0x9E3779B97F4A7C15)


def _key(hi: np.ndarray, lo: np.ndarray, a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return mix64(mix64((hi & a) + salt) ^ (lo & b))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every signature (rep, hi, lo, label) and table, the masked signature."""
    tables = list(zip(*_tables()))
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            n = part.num_rows
            hi, lo = (np.asarray(part.column(k)).view(U64) for k in (1, 2))
            key = np.empty((len(tables), n), U64)
            for k, (a, b, salt) in enumerate(tables):
                key[k] = _key(hi, lo, a, b, salt)
            rest = [pa.array(np.tile(np.asarray(part.column(k)), len(tables))) for k in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *rest], names=["key", *part.schema.names])


def _close(hi: np.ndarray, lo: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(hi[i] ^ hi[j]).astype(np.int64) + np.bitwise_count(lo[i] ^ lo[j]) <= RADIUS


def _first(key: np.ndarray, hi: np.ndarray, lo: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the key is that of the first table in which the pair meets."""
    x, y = hi[i] ^ hi[j], lo[i] ^ lo[j]
    a, b, salt = _tables()
    table = np.zeros(len(i), np.int64)
    for k in range(len(a) - 1, -1, -1):
        table[((x & a[k]) | (y & b[k])) == 0] = k
    return _key(hi[i], lo[i], a[table], b[table], salt[table]) == key[i]


def _spread(hi: np.ndarray, lo: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (of i, of j) within the radius."""
    p, q = np.nonzero(np.bitwise_count(hi[i][:, None] ^ hi[j]) + np.bitwise_count(lo[i][:, None] ^ lo[j]) <= RADIUS)
    return i[p], j[q]


def forest(hi: np.ndarray, lo: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius that connect all that such pairs connect: what is reached is compared with what isn't."""
    left, front, out = members, members[:0], []
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
        now, front = front[:TILE], front[TILE:]
        for y in range(0, len(left), TILE):
            a, b = _spread(hi, lo, now, left[y : y + TILE])
            b, first = np.unique(b, return_index=True)
            out.append((a[first], b))
            front = np.r_[front, b]
        left = left[~np.isin(left, front)]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (members[:0], members[:0])


def between(hi: np.ndarray, lo: np.ndarray, label: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius whose labels differ: the most frequent label's members are not compared with one another."""
    names, counts = np.unique(label[members], return_counts=True)
    most = label[members] == names[counts.argmax()]
    others, rest = members[~most], members[most]
    for x in range(0, len(others), TILE):
        i = others[x : x + TILE]
        for j in (rest, others[x:]):
            for y in range(0, len(j), TILE):
                a, b = _spread(hi, lo, i, j[y : y + TILE])
                keep = (label[a] != label[b]) & (a != b)
                yield a[keep], b[keep]


def bucket_pairs(key: np.ndarray, rep: np.ndarray, hi: np.ndarray, lo: np.ndarray, label: np.ndarray | None = None, crowd: int = CROWD) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs (a, b, of a forest) within the radius that share a key, each pair of a small bucket in one of its tables only.

    With labels, all pairs whose labels differ; without, buckets of more than `crowd` give a forest.
    """
    order = np.argsort(key, kind="stable")
    key, rep, hi, lo = key[order], rep[order], hi[order], lo[order]
    label = None if label is None else label[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.repeat(sizes <= crowd, sizes)

    def named(i, j, first=True):
        if first:
            keep = _first(key, hi, lo, i, j)
            i, j = i[keep], j[keep]
        return np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j]), not first

    for step in range(1, crowd):
        i = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
        if not len(i):
            break
        i = i[_close(hi, lo, i, i + step)]
        if label is not None:
            i = i[label[i] != label[i + step]]
        yield named(i, i + step)
    for s, n in zip(starts[sizes > crowd], sizes[sizes > crowd]):
        members = np.arange(s, s + n)
        if label is None:
            yield named(*forest(hi, lo, members), first=False)
        else:
            for i, j in between(hi, lo, label, members):
                yield named(i, j)


def _pairs(crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, rep, hi, lo, *label = (table.column(k).to_numpy() for k in range(table.num_columns))
        for a, b, crowded in bucket_pairs(key.view(U64), rep, hi.view(U64), lo.view(U64), label[0] if label else None, crowd):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowded))], names=["a", "b", "crowded"])

    return run


def candidates(reps: DataFrame, rows: int, crowd: int = CROWD) -> DataFrame:
    """(a, b, crowded) of signatures (rep, hi, lo[, label]), of which there are so many; tasks hold a bounded number of keys on average."""
    tables = len(_tables()[0])
    n = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * tables // KEYS))
    kind = "key long, rep long, hi long, lo long" + ", label long" * ("label" in reps.columns)
    return reps.mapInArrow(tidy(_keys), kind).repartition(n, "key").mapInArrow(tidy(_pairs(crowd)), "a long, b long, crowded boolean")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, texts of both) whose texts share enough words."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            keep = []
            for x, y in zip(bags(part.column(2)), bags(part.column(3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SHARED * (len(x) + len(y) - both))
            yield part.filter(pa.array(keep, pa.bool_())).select([0, 1])


def alike(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts are near duplicates."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
    rows = docs.select(row_key(docs).alias("key"), docs["text"].cast("string").alias("text")).join(small_side(ids, ids.count()), "key")
    texts = rows.dropDuplicates(["key"])
    left, right = (texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(tidy(_alike), "a long, b long")


def _labelled(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose members the roots don't connect."""
    a, b = (roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def verified(docs: DataFrame, reps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) among the classes (rep, hi, lo, n_words) that connect all that near duplicates within the radius connect.

    First every member meets the partner before it; then the other candidates whose
    members are still apart; last, where a forest stood for all pairs and is broken,
    all candidates across what is still apart. Texts of very unequal length cannot
    share enough.
    """
    a, b = (reps.select(F.col("rep").alias(x), F.col("n_words").alias(f"n_{x}")) for x in "ab")
    long_enough = lambda pairs: pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") >= SHARED * F.greatest("n_a", "n_b")).drop("n_a", "n_b")
    near = candidates(reps.select("rep", "hi", "lo"), reps.count(), crowd)
    near = written(near.groupBy("a", "b").agg(F.max("crowded").alias("crowded")), "near")
    possible = written(long_enough(near).select("a", "b"), "pairs")
    first = written(possible.groupBy("b").agg(F.max("a").alias("a")).select("a", "b"), "first")
    found = written(alike(docs, first), "alike")
    rest = written(_labelled(possible.join(first, ["a", "b"], "left_anti"), components(found)), "rest")
    if not rest.isEmpty():
        found = written(found.unionByName(alike(docs, rest)), "alike")
    roots = components(found)
    apart = _labelled(near, roots)
    if near.where("crowded").isEmpty() or apart.isEmpty():
        return found
    # what candidates connect, where some bucket gave a forest and some candidate is no edge
    whole = components(near)
    whole = written(whole.unionByName(whole.select(F.col("root").alias("id"), "root").distinct()), "whole")
    broken = apart.join(whole.withColumnRenamed("id", "a"), "a").select("root").union(apart.join(whole.withColumnRenamed("id", "b"), "b").select("root")).distinct()
    crowds = near.where("crowded").join(whole.withColumnRenamed("id", "a"), "a").select("root").distinct()
    again = whole.join(broken.join(crowds, "root"), "root").select(F.col("id").alias("rep")).join(reps, "rep").join(roots, F.col("rep") == F.col("id"), "left")
    again = written(again.select("rep", "hi", "lo", F.coalesce("root", "rep").alias("label")), "again")
    more = candidates(again, again.count(), crowd).select("a", "b").distinct()
    more = long_enough(more.join(first, ["a", "b"], "left_anti").join(rest, ["a", "b"], "left_anti"))
    return found.unionByName(alike(docs, written(more, "more")))


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, roots): the least id of each component, by pointer jumping."""
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(edges: DataFrame, held_edges: int = HELD_EDGES) -> DataFrame:
    """(id, root) of every node of the edges (a, b) but the roots: on the driver up to so many edges, beyond that by alternating large and small stars."""
    held = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if held.count() <= held_edges:
        table = held.toArrow()
        ids, roots = joined_up(*(table.column(c).to_numpy() for c in ("a", "b")))
        inner = ids != roots
        found = pa.table({"id": pa.array(ids[inner], pa.int64()), "root": pa.array(roots[inner], pa.int64())})
        return written(edges.sparkSession.createDataFrame(found, "id long, root long"), "roots")
    state = None
    while True:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.withColumn("m", low).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.withColumn("m", F.min("a").over(Window.partitionBy("b")))
        small = least.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
        held = written(small.where("a <> b").distinct(), "stars")
        new = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return held.select(F.col("b").alias("id"), F.col("a").alias("root"))
        state = new


def groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(key, doc_id, kept_key, kept_id) of every document that another one of its group replaces."""
    one = written(signatures(docs).where("n_words > 0").dropDuplicates(["key"]), "signatures")
    reps = written(one.groupBy("hi", "lo", "digest").agg(F.min("key").alias("rep"), F.min("n_words").alias("n_words"), F.count("*").alias("n")), "classes")
    roots = components(verified(docs, reps.select("rep", "hi", "lo", "n_words"), crowd))
    # classes of one member that nothing joins stay out of what follows
    inner = roots.select(F.col("id").alias("rep"), "root").unionByName(roots.select(F.col("root").alias("rep"), "root").distinct())
    classes = reps.join(inner, "rep", "left").where("root is not null or n > 1").select("hi", "lo", "digest", F.coalesce("root", "rep").alias("class"))
    classes = written(classes, "grouped")
    members = written(one.join(small_side(classes, classes.count()), ["hi", "lo", "digest"]).select("key", "doc_id", "class"), "members")
    least = members.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("kept"))
    least = written(least, "kept")
    joined = members.join(small_side(least, least.count()), "class")
    return joined.where("key <> kept.key").select("key", "doc_id", F.col("kept.key").alias("kept_key"), F.col("kept.doc_id").alias("kept_id"))


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, kept_id) of every document that another one of its group replaces."""
    return groups(docs, crowd).select("doc_id", "kept_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that no other one of their group replaces; columns as they were, whatever their names.

    Of rows equal in doc_id and text one stays, that of the least JSON.
    """
    gone = written(groups(docs).select(F.col("key").alias("_key")).distinct(), "duplicates")
    left = docs.withColumn("_key", row_key(docs)).join(small_side(gone, gone.count()), "_key", "left_anti")
    again = written(docs.select(row_key(docs).alias("_key")).groupBy("_key").count().where("count > 1").select("_key"), "repeated")
    n = again.count()
    if not n:
        return left.select(docs.columns)
    again, row = small_side(again, n), F.struct(*docs.columns)
    once = left.join(again, "_key", "left_semi").groupBy("_key").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return left.join(again, "_key", "left_anti").select(docs.columns).unionByName(once)
