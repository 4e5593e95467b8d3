"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Encoding runs in one pass without a shuffle. Documents are gathered into slabs of
`SLAB_BYTES` of text; each slab's distinct words are handed to Spark once, as byte
arrays, in rows of `FOLDED` words. Spark folds the ranked merges over the bytes of
every distinct word with higher-order functions and a rank map that is a literal of
the plan. Then the documents' words are replaced by their ids.

A word under way is an array of 64-bit numbers, one for each piece: the rank of the
pair that it begins << 16 | its id. The least number is the pair to merge next,
the leftmost of equal ones; its rank is the merged piece's id. The rank map is a
literal array of rows by left id, laid over one another.

Words are found in whole blocks of text at once: every code point has a class
(letter, number, white space, other), and a word begins where `PATTERN` begins one.

Decoding concatenates the pieces' bytes, again from a literal array.

Defined cases: a null text has null ids and 0 tokens, an empty one empty ids.
Words of more than `LONG_WORD` bytes are merged with a heap in Python, to the
same result: the fold takes steps as the square of a word's length. Texts of any
length are encoded whole; one that is longer than a slab is a slab of its own.
Special tokens' strings are ordinary text. Repeated rows repeat their results, each
row for itself; null ids decode to null. Other columns, whatever their names, are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, lean, tidy, utf8, word_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual pre-tokeniser of byte-level BPE; what begins most words is tried first.
PATTERN = r" ?\p{L}++| ?\p{N}++|'(?:[sdmt]|ll|ve|re)| ?[^\s\p{L}\p{N}]++|\s++(?!\S)|\s(?=\S)|\s+(?!\S)|\s+"
#: Text in one slab; a longer document is a slab of its own.
SLAB_BYTES = 32 << 20
#: Text in which words are found at once, and distinct words of a slab in one row.
BLOCK_BYTES, FOLDED = 1 << 20, 2048
#: Words of documents in one row.
TOKENS = 60_000
LONG_WORD = 256
#: A piece whose number is that great begins no pair that merges.
NO_RANK = 1 << 32
#: The id that stands at both ends of a word; it merges with nothing.
EDGE = 65_535
_EMPTY = 1 << 60

SLAB = "ids array<long>, valid array<boolean>, sizes binary, codes binary, words array<array<smallint>>, long_words array<binary>"
ENCODED = "doc_id long, token_ids array<int>, n_tokens long"


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ranked merges of one word in n log n steps."""
    n = len(word)
    nxt, prev, piece = list(range(1, n + 1)), list(range(-1, n - 1)), [word[i : i + 1] for i in range(n)]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if not piece[i] or (j := nxt[i]) >= n or len(piece[i]) + len(piece[j]) != size:
            continue
        piece[i], piece[j] = piece[i] + piece[j], b""
        nxt[i] = k = nxt[j]
        if k < n:
            prev[k] = i
        for a, b in ((prev[i], i), (i, k)):
            if a >= 0 and b < n and (r := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a, len(piece[a]) + len(piece[b])))
    return [ranks[p] for p in piece if p]


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> merged id, the last merge that makes each token."""
    found = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            least, best = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if least >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            found[ranks[parts[0]], ranks[parts[1]]] = rank
    return found


@lru_cache(maxsize=4)
def rank_tables(path: str = VOCABULARY) -> tuple[list[int], list[int]]:
    """The rank map by row displacement: table[shift[a] + b] is a << 40 ^ merged id << 16 if (a, b) merges; else no other a makes it less than 2**32."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), merged in merges(vocabulary(path)).items():
        rows.setdefault(a, []).append((b, merged))
    free, table, shift = np.ones(1 << 20, bool), np.full(1 << 20, _EMPTY), np.zeros(EDGE + 1, np.int64)
    low = 0
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        b, merged = np.array(sorted(row)).T
        while True:
            # the first slots that are free; the row's least id goes to one of them
            slots = low + np.flatnonzero(free[low : low + 4096])
            maybe = slots[slots >= b[0]] - b[0]
            fits = free[maybe[:, None] + b].all(axis=1)
            if fits.any():
                break
            low += 4096
        o = int(maybe[fits.argmax()])
        shift[a] = o
        free[o + b], table[o + b] = False, (a << 40) ^ (merged << 16)
        low = 0 if len(b) > 1 else low
    return table[: shift.max() + EDGE + 1].tolist(), shift.tolist()


def _literal(values: list, kind: str) -> Column:
    """An array literal: constant folding turns the text into one."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _let(value: Column, body) -> Column:
    """body of a value worked out once: an empty fold's last step. Unlike an array's only element, it asks no type of body while it runs."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


class Encoder:
    """Column builders over one vocabulary."""

    def __init__(self, path: str = VOCABULARY):
        ranks = vocabulary(path)
        table, shift = rank_tables(path)
        self.table, self.shift = _literal(table, "bigint"), _literal(shift, "bigint")
        self.byte = _literal([ranks[bytes([b])] for b in range(256)], "bigint")
        pieces = dict((v, k) for k, v in ranks.items())
        # a byte is a character of ISO-8859-1; the separator is none of them
        self.pieces = F.split(F.lit("\u0100".join(pieces.get(i, b"").decode("latin-1") for i in range(max(pieces) + 1))), "\u0100")

    def fold_all(self, words: Column) -> Column:
        """The ids of each word, an array of bytes; the tables are bound once, so that the plan holds one copy of each."""
        return _let(self.table, lambda t: _let(self.shift, lambda s: _let(self.byte, lambda b: F.transform(words, lambda w: self.fold(w, t, s, b)))))

    def fold(self, word: Column, table: Column, shift: Column, byte: Column) -> Column:
        """The ids of one word."""
        def rank(a: Column, b: Column) -> Column:
            """A pair's rank << 16; NO_RANK or more without one."""
            return table[shift[a] + b].bitwiseXOR(F.shiftleft(a, 40))

        def start(s: Column) -> Column:
            return F.transform(s, lambda a, i: F.coalesce(rank(a, F.get(s, i + 1)), F.lit(_EMPTY)) + a)

        def step(e: Column, _: Column) -> Column:
            return _let(F.array_min(e), lambda m: F.when(m >= NO_RANK, e).otherwise(_let((F.array_position(e, m) - 1).cast("int"), lambda p: merged(e, F.shiftright(m, 16), p))))

        def merged(e: Column, new: Column, p: Column) -> Column:
            """The piece at p becomes the new one, that before it gets a new pair, those behind move up; behind the last there is null."""
            whole = rank(new, e[p + 2].bitwiseAND(65535)) + new
            left = lambda x: _let(x.bitwiseAND(65535), lambda a: rank(a, new) + a)
            # the edges see to it that there is a piece on either side
            return _let(p - 1, lambda q: F.transform(e, lambda x, i: F.when(i < q, x).when(i > p, F.get(e, i + 1)).when(i == p, whole).otherwise(left(x))))

        def ids(e: Column) -> Column:
            return F.transform(F.filter(e, lambda x: x.bitwiseAND(65535) != EDGE), lambda x: x.bitwiseAND(65535).cast("int"))

        edge = F.array(F.lit(EDGE).cast("bigint"))
        return _let(F.concat(edge, F.transform(word, lambda c: byte[c]), edge), lambda s: F.aggregate(F.slice(word, 2, F.size(word)), start(s), step, ids))

    def decode(self, ids: Column) -> Column:
        """The bytes of a row of ids."""
        return F.encode(_let(self.pieces, lambda pieces: F.array_join(F.transform(ids, lambda i: pieces[i]), "")), "ISO-8859-1")


LETTER, NUMBER, SPACE, OTHER = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the pattern's own engine sees it."""
    out = np.full(0x110000, OTHER, np.int8)
    every = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4").tobytes().decode("utf-32-le")
    for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(what, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    return out


def word_starts(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where PATTERN begins a word in the code points of texts one behind another; edges: where texts begin."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[edges] = first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    starts, ends = run[:n].copy(), run[1:]
    space = kind == SPACE
    # the last space of a run before other text stands apart, or with what follows if it is a blank
    last = np.flatnonzero(space & ends & ~first[1:])
    starts[last] = True
    blank = last[codes[last] == 32]
    starts[blank + 1] = False
    # an apostrophe by itself takes the letters of a contraction
    quote = np.flatnonzero((codes == 39) & starts[:n] & ends & ~first[1:])
    if len(quote):
        quote = quote[kind[quote + 1] == LETTER]
        one = codes[quote + 1]
        two = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], codes[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "sdmt"])
        long = (one == 108) & (two == 108) | (one == 118) & (two == 101) | (one == 114) & (two == 101)
        for taken, size in ((quote[short], 1), (quote[long], 2)):
            starts[taken + 1] = False
            after = taken + 1 + size
            after = after[(after < n)]
            # the rest of the letters begins a word; what is no letter has begun one, or a blank before it has
            after = after[(kind[after] == LETTER) & ~first[after]]
            starts[after] = True
    return np.flatnonzero(starts)


def words_of(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, words' byte places and their end, words before each row) of blocks of whole rows."""
    raw, offsets, valid = utf8(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        data = raw[offsets[row] : offsets[end]]
        at = offsets[row : end + 1] - offsets[row]
        lead = (data & 0xC0) != 0x80
        places = np.flatnonzero(lead)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        edges = np.searchsorted(places, at)
        starts = word_starts(codes, edges[:-1][edges[:-1] < len(codes)])
        yield row, end, data, np.r_[places[starts], len(data)], np.searchsorted(starts, edges)
        row = end


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one behind another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Slab:
    """Documents' words as numbers of distinct words."""

    def __init__(self):
        self.ids, self.valid, self.sizes, self.codes, self.words, self.size = [], [], [], [], [], 0

    def add(self, ids: pa.Array, valid: np.ndarray, data: np.ndarray, at: np.ndarray, before: np.ndarray) -> None:
        self.ids += ids.to_pylist()
        self.valid += valid.tolist()
        self.sizes.append(np.diff(before))
        codes, hashes = pd.factorize(word_hashes(data, at[:-1], at[1:]))
        # numbers are given in the order of first places
        first = np.flatnonzero(codes > np.maximum.accumulate(np.r_[-1, codes[:-1]])[: len(codes)])
        lengths = at[first + 1] - at[first]
        self.codes.append(codes.astype(np.int32))
        self.words.append((hashes, lengths, data[_runs(at[first], lengths)]))
        self.size += len(data)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows of FOLDED distinct words each, then rows of documents of about TOKENS words."""
        hashes, lengths = (np.concatenate(x) for x in zip(*((h, n) for h, n, _ in self.words)))
        numbers, _ = pd.factorize(hashes)
        numbers = numbers.astype(np.int32)
        first = np.flatnonzero(numbers > np.maximum.accumulate(np.r_[np.int32(-1), numbers[:-1]])[: len(numbers)])
        del hashes
        at = np.cumsum([0, *(len(h) for h, _, _ in self.words)])
        data = np.concatenate([d for _, _, d in self.words])
        self.words = []
        places, lengths = (np.cumsum(lengths) - lengths)[first], lengths[first]
        for a in range(0, len(first), FOLDED):
            n = lengths[a : a + FOLDED]
            short = n <= LONG_WORD
            part = data[_runs(places[a : a + FOLDED][short], n[short])]
            words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(short, n, 0))].astype(np.int32)), pa.array(part.astype(np.int16)))
            long = [data[x : x + y].tobytes() for x, y in zip(places[a : a + FOLDED][~short], n[~short])]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(_KIND)[:4]), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), words), pa.array([long], pa.list_(pa.binary()))], schema=_KIND)
        del data
        docs = 0
        for block, (codes, sizes) in enumerate(zip(self.codes, self.sizes)):
            codes, self.codes[block] = numbers[at[block] : at[block + 1]][codes], None
            ends = np.cumsum(sizes)
            x = 0
            while x < len(sizes):
                done = int(ends[x] - sizes[x])
                y = max(x + 1, int(np.searchsorted(ends, done + TOKENS, "right")))
                one = {"ids": self.ids[docs + x : docs + y], "valid": self.valid[docs + x : docs + y], "sizes": sizes[x:y].astype(np.int64).tobytes(), "codes": codes[done : int(ends[y - 1])].tobytes(), "words": [], "long_words": []}
                yield pa.RecordBatch.from_pylist([one], schema=_KIND)
                x = y
            docs += len(sizes)


_KIND = pa.schema([("ids", pa.list_(pa.int64())), ("valid", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("codes", pa.binary()), ("words", pa.list_(pa.list_(pa.int16()))), ("long_words", pa.list_(pa.binary()))])


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents gathered into slabs."""
    slab = Slab()
    for batch in batches:
        for row, end, data, at, before in words_of(batch.column(1)):
            if slab.size and slab.size + len(data) > SLAB_BYTES:
                yield from slab.rows()
                slab = Slab()
            part = batch.slice(row, end - row)
            slab.add(part.column(0), np.asarray(part.column(1).is_valid(), dtype=bool), data, at, before)
    if slab.ids:
        yield from slab.rows()


def _with_long(sizes: np.ndarray, ids: np.ndarray, long: list[bytes], ranks) -> tuple[np.ndarray, np.ndarray]:
    """A row's ids with those of its long words, whose places have none, put in."""
    sizes = sizes.astype(np.int64)
    if long:
        extra = [np.array(merge_long(w, ranks.value), ids.dtype) for w in long]
        places = np.flatnonzero(sizes == 0)
        ids = np.insert(ids, np.repeat((np.cumsum(sizes) - sizes)[places], [len(x) for x in extra]), np.concatenate(extra))
        sizes[places] = [len(x) for x in extra]
    return sizes, ids


def _put_together(spark: SparkSession, path: str):
    # the driver reads the vocabulary; tasks need not have the file
    held_ranks = spark.sparkContext.broadcast(vocabulary(path))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the slab under way: how many ids each distinct word has, and all of them
        held: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = ids = starts = None
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            for row in range(batch.num_rows):
                if not get("codes")[row].is_valid:
                    encoded = get("encoded")[row].values
                    at = np.asarray(encoded.offsets)
                    held.append(_with_long(np.diff(at), np.asarray(encoded.values)[at[0] : at[-1]], get("long_words")[row].as_py(), held_ranks))
                    sizes = None
                    continue
                if sizes is None:
                    sizes, ids = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int32))
                    held, starts = [], np.cumsum(sizes) - sizes
                codes = np.frombuffer(get("codes")[row].as_buffer(), np.int32)
                n = sizes[codes]
                ends = np.cumsum(n)
                where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - ends + n, n)
                edges = np.r_[0, ends][np.r_[0, np.cumsum(np.frombuffer(get("sizes")[row].as_buffer(), np.int64))]]
                valid = np.asarray(get("valid")[row].values)
                offsets = pa.array(edges.astype(np.int32), mask=np.r_[~valid, False])
                yield pa.RecordBatch.from_arrays([get("ids")[row].values, pa.ListArray.from_arrays(offsets, pa.array(ids[where], pa.int32())), pa.array(np.diff(edges))], names=["doc_id", "token_ids", "n_tokens"])

    return build


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens) of every row of docs."""
    encoder = Encoder(path)
    slabs = lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_slabs), SLAB)
    ids = encoder.fold_all(F.col("words"))
    return slabs.select("ids", "valid", "sizes", "codes", "long_words", ids.alias("encoded")).mapInArrow(tidy(_put_together(docs.sparkSession, path)), ENCODED)


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the bytes of token_ids as UTF-8."""
    return tokens.select("doc_id", F.decode(Encoder(path).decode(F.col("token_ids")), "UTF-8").alias("text"))


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens, text): every row encoded, and what its ids decode to."""
    text = F.decode(Encoder(path).decode(F.col("token_ids")), "UTF-8")
    return encoded(docs, path).withColumn("text", text)
