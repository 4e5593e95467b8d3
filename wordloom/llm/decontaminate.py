"""Benchmark decontamination: edit distance by CGK embedding and bit sampling.

Texts are compared as sequences of lower-cased words. For a benchmark item of n
words every window of n words of every document is a candidate; it matches if
its word edit distance to the item is at most floor(MAX_EDITS * n).

1. An edit makes at most one word and two adjacent word pairs of a window foreign
   to the item. So a window with more words foreign to the whole benchmark than
   edits are allowed, or with more than twice as many foreign pairs, cannot
   match. Running counts drop these windows without loss. Of the others, those go that
   have more words or pairs foreign to all items of the window's length.
2. The CGK random walk reads a sequence for 2 n steps; a random bit of (step,
   word) says whether it moves on. Few edits become few Hamming differences.
   Sampled positions of the walk are hashed, in as many independent walks and
   samples as are needed to meet the target recall at the greatest distance allowed.
   The number comes from simulated edits of the items themselves: walks are added
   until the recall of edits that had no part in the choice is above the target by
   the lower bound of its confidence interval, for every length by itself.
3. Windows that share a hash with an item are verified by exact edit distance.

Defined cases: null and empty documents match nothing; items without words
match nothing; items with fewer words than 1 / MAX_EDITS match exactly only. An
empty benchmark or corpus gives no rows. In `contaminated`, rows of one doc_id (or
of none) count as one document; `drop_contaminated` judges every row by itself. Of
places equally close the first counts; equal items are reported each. Documents of
any length are searched whole, in blocks of whole documents. Other columns, whatever
their names, are not read. The benchmark is held by every task; above `ITEM_WORDS`
words it is taken in several passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, lean, lowered, mix64, row_key, small_side, tidy, word_hashes, word_spans, written

MAX_EDITS = 0.15
TARGET_RECALL = 0.97
#: Words of benchmark text in one pass.
ITEM_WORDS = 2_000_000
SAMPLES_PER_WALK = 8
#: Positions sampled for one hash.
SAMPLE = 3
#: Simulated edits of each length at once, and the recall that they must have before others are asked.
EDITED, AMPLE_RECALL = 600, 0.985

HITS = "doc_id long, item_id long, edits int, at_word long"


def words_of(text: str) -> np.ndarray:
    column = lowered(pa.array([text], pa.string()))
    _, _, data, offsets = next(blocks(column, 1 << 40))
    first, last, _ = word_spans(data, offsets)
    return word_hashes(data, first, last)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return mix64(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:])


def walk(seqs: np.ndarray, seed: int) -> np.ndarray:
    """The walks over equally long rows of word hashes: the first 2 n symbols of each, 0 after the end."""
    m, n = seqs.shape
    # a walk of 2 n steps ends among the zeros behind the words
    padded = np.zeros((m, 2 * n), U64)
    padded[:, :n] = seqs
    padded, at = padded.ravel(), np.arange(m) * (2 * n)
    out, bit = np.empty((2 * n, m), U64), np.empty(m, U64)
    for j in range(2 * n):
        padded.take(at, out=out[j], mode="clip")
        salt = U64((seed * 0x9E3779B97F4A7C15 + (j + 1) * 0xD1B54A32D192ED03) & (1 << 64) - 1)
        np.bitwise_xor(out[j], salt, out=bit)
        bit *= U64(0xBF58476D1CE4E5B9)
        bit >>= U64(63)
        at += bit.view(np.int64)
    return out


def sample_hashes(walks: np.ndarray, n: int, seed: int) -> np.ndarray:
    """One hash for each of the samples of a walk: (SAMPLES_PER_WALK, rows)."""
    rng = np.random.default_rng((seed, n))
    out = np.zeros((SAMPLES_PER_WALK, walks.shape[1]), U64)
    for k in range(SAMPLES_PER_WALK):
        out[k] = U64(seed * 64 + k + 1)
        for p in rng.choice(2 * n, min(SAMPLE, 2 * n), replace=False):
            out[k] = mix64(out[k] ^ walks[p])
    return out


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distances of equally long row pairs."""
    m, n = a.shape
    row = np.tile(np.arange(n + 1, dtype=np.int32), (m, 1))
    steps = np.arange(n + 1, dtype=np.int32)
    for i in range(1, n + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i - 1, None] != b))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[:, n]


def _edited(item: np.ndarray, edits: int, rng: np.random.Generator, other: np.ndarray) -> np.ndarray:
    """The item's length of words after so many random edits."""
    left = item.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(left)))
        if kind == 0:
            left[at] = int(rng.choice(other))
        elif kind == 1:
            left.insert(at, int(rng.choice(other)))
        elif len(left) > 1:
            del left[at]
    tail = rng.choice(other, len(item)).tolist()
    return np.array((left + tail)[: len(item)], U64)


@dataclass
class Index:
    """The benchmark: its words, its adjacent pairs, by item length which of them the items have, and by item length ids, word hashes, number of walks, sorted hashes and their owners."""

    vocabulary: np.ndarray
    pairs: np.ndarray
    own: dict[int, tuple[np.ndarray, np.ndarray]]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]


def _simulated(seqs: np.ndarray, k: int, rng: np.random.Generator, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items and what random edits make of them, k edits apart (fewer where edits of k can't be)."""
    true = seqs[np.arange(EDITED) % len(seqs)]
    changed = np.stack([_edited(s, k, rng, other) for s in true])
    d = edit_distance(true, changed)
    most = d[d <= k].max(initial=0)
    return true[d == most], changed[d == most]


def _meet(true: np.ndarray, changed: np.ndarray, n: int, walks: range) -> np.ndarray:
    """Which pairs share a hash in one of the walks."""
    met = np.zeros(len(true), bool)
    for s in walks:
        met |= (sample_hashes(walk(true, s), n, s) == sample_hashes(walk(changed, s), n, s)).any(axis=0)
    return met


def lower_bound(right: int, n: int, z: float = 1.64) -> float:
    """Of the share that right of n are a sample of (Wilson)."""
    p = right / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def walks_needed(seqs: np.ndarray, k: int, rng: np.random.Generator, other: np.ndarray, target: float) -> int:
    """Walks until the recall of edits drawn anew is above the target."""
    walks, ample = 0, max(AMPLE_RECALL, target)
    true, changed = _simulated(seqs, k, rng, other)
    met = np.zeros(len(true), bool)
    while len(true):
        while not walks or met.mean() < ample:
            walks += 1
            met |= _meet(true, changed, seqs.shape[1], range(walks, walks + 1))
        fresh = _simulated(seqs, k, rng, other)
        held = _meet(*fresh, seqs.shape[1], range(1, walks + 1))
        if lower_bound(int(held.sum()), len(held)) >= target or not len(held):
            break
        true, changed, met = np.concatenate([true, fresh[0]]), np.concatenate([changed, fresh[1]]), np.r_[met, held]
        ample = 1 - (1 - ample) / 2
    return max(walks, 1)


def build_index(items: list[tuple[int, np.ndarray]], target: float = TARGET_RECALL, seed: int = 11) -> Index:
    items = [(i, w) for i, w in items if len(w)]
    vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, U64)
    pairs = np.unique(np.concatenate([pair_hashes(w) for _, w in items])) if items else vocabulary
    by_length, own = {}, {}
    for n in sorted({len(w) for _, w in items}):
        ids = np.array([i for i, w in items if len(w) == n])
        seqs = np.stack([w for _, w in items if len(w) == n])
        k = int(MAX_EDITS * n)
        walks = walks_needed(seqs, k, np.random.default_rng((seed, n)), vocabulary, target) if k else 1
        keys = np.concatenate([sample_hashes(walk(seqs, s), n, s).ravel() for s in range(1, walks + 1)])
        owner = np.tile(np.arange(len(seqs)), SAMPLES_PER_WALK * walks)
        order = np.argsort(keys, kind="stable")
        by_length[n] = (ids, seqs, walks, keys[order], owner[order])
        own[n] = tuple(np.r_[np.isin(known, np.concatenate([f(s) for s in seqs])), False] for known, f in ((vocabulary, lambda s: s), (pairs, pair_hashes)))
    return Index(vocabulary, pairs, own, by_length)


def _candidates(windows: np.ndarray, n: int, walks: int, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distinct (window, item) pairs that share a hash."""
    pairs, table = [], marks(keys)
    for s in range(1, walks + 1):
        h = sample_hashes(walk(windows, s), n, s)
        # few hashes are an item's: the first bits tell
        which, row = np.nonzero(table[(h >> U64(64 - MARK_BITS)).astype(np.int32)])
        h = h[which, row]
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        while (found := np.flatnonzero(lo < hi)).size:
            pairs.append(np.stack([row[found], owner[lo[found]]], axis=1))
            lo[found] += 1
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


#: The first bits of a hash that mark in a table what may be known.
MARK_BITS = 20


def marks(known: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << MARK_BITS, bool)
    table[(known >> U64(64 - MARK_BITS)).astype(np.int64)] = True
    return table


def _places(h: np.ndarray, known: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each hash's place among the known ones; behind the last if it is none of them."""
    at = np.full(len(h), len(known), np.int32)
    if len(known):
        maybe = np.flatnonzero(table[(h >> U64(64 - MARK_BITS)).astype(np.int32)])
        found = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
        at[maybe] = np.where(known[found] == h[maybe], found, len(known))
    return at


def _running(marks_: np.ndarray) -> np.ndarray:
    counts = np.zeros(len(marks_) + 1, np.int32)
    np.cumsum(marks_, out=counts[1:])
    return counts


def _few(places: np.ndarray, starts: np.ndarray, n: int, own: np.ndarray, most: int) -> np.ndarray:
    """The starts of the runs of n of which at most so many are not the items' own."""
    keep = [own[places[part[:, None] + np.arange(n)]].sum(axis=1) >= n - most for part in np.split(starts, range(1 << 14, len(starts), 1 << 14))]
    return starts[np.concatenate(keep)] if len(starts) else starts


def windows_of(data: np.ndarray, offsets: np.ndarray, index: Index, tables: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, windows, their rows, their word positions) of all windows that may match."""
    first, last, rows = word_spans(data, offsets)
    h = word_hashes(data, first, last)
    if not len(h):
        return
    words, pairs = _places(h, index.vocabulary, tables[0]), _places(pair_hashes(h), index.pairs, tables[1])
    strange, strange_pairs = _running(words == len(index.vocabulary)), _running(pairs == len(index.pairs))
    begins = np.searchsorted(rows, np.arange(len(offsets)))
    for n in index.by_length:
        if len(h) < n:
            continue
        k = int(MAX_EDITS * n)
        starts = np.flatnonzero(strange_pairs[n - 1 :] - strange_pairs[: len(h) - n + 1] <= 2 * k)
        starts = starts[strange[starts + n] - strange[starts] <= k]
        starts = starts[rows[starts] == rows[starts + n - 1]]
        starts = _few(words, starts, n, index.own[n][0], k)
        starts = _few(pairs, starts, n - 1, index.own[n][1], 2 * k)
        for cut in range(0, len(starts), 1 << 14):
            part = starts[cut : cut + (1 << 14)]
            yield n, h[part[:, None] + np.arange(n)], rows[part], part - begins[rows[part]]


def matches(windows: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item id, edits) of all verified matches of windows of one length."""
    n = windows.shape[1]
    ids, seqs, walks, keys, owner = index.by_length[n]
    digest = np.zeros(len(windows), U64)
    for column in windows.T:
        digest = mix64(digest ^ column)
    _, first, same = np.unique(digest, return_index=True, return_inverse=True)
    all_windows, windows = windows, windows[first]
    pairs = _candidates(windows, n, walks, keys, owner)
    d = np.concatenate([np.zeros(0, np.int32), *(edit_distance(windows[p[:, 0]], seqs[p[:, 1]]) for p in np.split(pairs, range(1 << 12, len(pairs), 1 << 12)))])
    good = d <= int(MAX_EDITS * n)
    pairs, d = pairs[good], d[good]
    # back from the distinct windows to all that are equal to them
    lo, hi = np.searchsorted(pairs[:, 0], same, "left"), np.searchsorted(pairs[:, 0], same, "right")
    window = np.repeat(np.arange(len(all_windows)), hi - lo)
    pair = np.arange(len(window)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    return window, ids[pairs[pair, 1]], d[pair]


#: Windows of one length gathered before they are matched, and words of windows of all lengths.
GATHER, GATHERED_WORDS = 1 << 13, 2 << 20


def search_column(column: pa.Array, index: Index) -> tuple[np.ndarray, ...]:
    """(row, item id, edits, word position) of each item's best place in each row."""
    tables, held, found = (marks(index.vocabulary), marks(index.pairs)), {}, []

    def settle(n: int) -> None:
        windows, rows, at = (np.concatenate(x) for x in zip(*held.pop(n)))
        w, item, d = matches(windows, index)
        found.append((rows[w], item, d, at[w]))

    size: dict[int, int] = {}
    for row, _, data, offsets in blocks(lowered(column)):
        for n, windows, rows, at in windows_of(data, offsets, index, tables):
            held.setdefault(n, []).append((windows, rows + row, at))
            size[n] = size.get(n, 0) + len(rows)
            if size[n] > GATHER:
                settle(n)
                size.pop(n)
            while sum(k * v for k, v in size.items()) > GATHERED_WORDS:
                most = max(size, key=lambda k: k * size[k])  # noqa: B023
                settle(most)
                size.pop(most)
    for n in list(held):
        settle(n)
    r, item, d, at = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    order = np.lexsort((at, d, item, r))
    r, item, d, at = r[order], item[order], d[order], at[order]
    best = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (item[1:] != item[:-1])][: len(r)])
    return r[best], item[best], d[best].astype(np.int32), at[best]


def _searcher(index: Index):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, item, d, at = search_column(batch.column(1), index)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(item), pa.array(d), pa.array(at)], names=["doc_id", "item_id", "edits", "at_word"])

    return search


def _hits(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, at_word) of every row (doc_id, text) and item."""
    # the benchmark is small beside the corpus; its passes are bounded by ITEM_WORDS each
    parts, size = [[]], 0
    for item_id, text in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        w = words_of(text)
        if size + len(w) > ITEM_WORDS and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append((item_id, w))
        size += len(w)
    found = lean(texts).sparkSession.createDataFrame([], HITS)
    for part in parts:
        index = build_index(part)
        if index.by_length:
            found = found.unionByName(texts.where("text is not null").mapInArrow(tidy(_searcher(index)), HITS))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, at_word): the closest, first place of each item in each document that holds it."""
    found = _hits(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), benchmark)
    best = F.min(F.struct("edits", "at_word"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.edits", "best.at_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item; columns as they were, whatever their names."""
    keyed = docs.select(row_key(docs).alias("doc_id"), docs["text"].cast("string").alias("text"))
    hit = written(_hits(keyed, benchmark).select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.withColumn("_key", row_key(docs)).join(small_side(hit, hit.count()), "_key", "left_anti").select(docs.columns)
