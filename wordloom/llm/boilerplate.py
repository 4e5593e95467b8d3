"""HTML extraction with host suffix arrays.

A page's visible text (without scripts, styles, comments and tags; entities
decoded) is a stream of tokens. What a host repeats is boilerplate: every run of
at least `LEAST` tokens that also stands on another page of the same host. Such runs
are removed, the others are kept.

A host of at most `BLOCK` bytes goes to one task, packed and compressed. Its pages'
streams are concatenated and their suffixes sorted by prefix doubling, to the depth
that decides, LEAST tokens. Neighbours in the array that share a prefix of that
length form an interval; an interval with two pages is a repeat, and what the
repeats cover is removed. Small hosts are sorted many at a time.

A larger host does not fit a task. Its pages stay where they are, and each task lays
out the arrays of the pages that it has; what the arrays have in common meets by key:

1. Anchors. Of every LEAST - GRAM + 1 successive GRAM-token substrings the one of least
   hash is an anchor, so that equal runs of LEAST tokens share one. An anchor that
   two pages of a host have is shared; a run without one repeats nowhere, and its
   suffixes need no place in an array.
2. Suffix arrays. Each task sorts the suffixes near shared anchors. An interval
   becomes one row for each page: the digest of its LEAST tokens. Rows of all tasks
   meet by digest; an interval with two pages is a repeat.
3. Each page loses the tokens that repeats cover.

Shared anchors and repeats are handed to the tasks if they are at most `HELD` rows;
beyond that the pages' places are joined to them. Both ways give the same result.

Defined cases: a null page stays null, an empty one empty; pages of any length count
whole. Rows that repeat a page_id are one page: they are no repeat of each other. Rows
without a page_id repeat nothing and keep all tokens. A null or malformed URL is a host
of its own, the empty one. Repeats that overlap are removed together. Only page_id, url
and html are read, whatever the names of other columns. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, lean, mix64, small_side, tidy, word_hashes, word_spans, written

LEAST, GRAM = 12, 4
HELD = 2_000_000
#: Bytes of a host, or of several small ones, whose suffixes are sorted in one place.
BLOCK = 8 << 20
_GONE = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[!/?a-z][^>]*>")
_TOKEN = np.ones(256, bool)
_TOKEN[[9, 10, 11, 12, 13, 32]] = False


def visible(page: str) -> str:
    """The text that a reader sees."""
    return html.unescape(_GONE.sub(" ", page)).replace(" ", " ")


def stream(pages: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text bytes and its tokens' starts, ends, rows and hashes."""
    column = pa.array([visible(p) if p else "" for p in pages], pa.large_string())
    _, _, data, offsets = next(blocks(column, 1 << 60))
    first, last, rows = word_spans(data, offsets, _TOKEN)
    return data.tobytes(), first, last, rows, word_hashes(data, first, last)


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n tokens."""
    h = np.zeros(max(0, len(tokens) - n + 1), U64)
    for k in range(n if len(h) else 0):
        h = mix64(h + tokens[k : k + len(h)])
    return h


def anchors(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors; rows shorter than LEAST have none."""
    h, w = gram_hashes(tokens, GRAM), LEAST - GRAM + 1
    if len(h) < w:
        return np.zeros(0, np.int64), h[:0]
    low = np.lib.stride_tricks.sliding_window_view(h, w).argmin(axis=1) + np.arange(len(h) - w + 1)
    inside = rows[: len(tokens) - LEAST + 1] == rows[LEAST - 1 :]
    at = np.unique(low[inside])
    return at, h[at]


def hosts_of(urls: pa.Array, rows: int) -> np.ndarray:
    """A hash of each host."""
    out = np.zeros(rows, U64)
    for i, host in enumerate(urls.to_pylist()):
        data = np.frombuffer((host or "\x00").encode(), np.uint8)
        out[i] = word_hashes(data, np.array([0]), np.array([len(data)]))[0]
    return out


def _in(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def near(places: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of the runs of LEAST tokens that hold an anchor at one of the places."""
    n = len(rows) - LEAST + 1
    if n <= 0 or not len(places):
        return np.zeros(0, np.int64)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(places - (LEAST - GRAM), 0, n), 1)
    np.add.at(change, np.minimum(places + 1, n), -1)
    return np.flatnonzero((np.cumsum(change)[:n] > 0) & (rows[:n] == rows[LEAST - 1 :]))


def suffix_array(streams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their suffixes' first LEAST tokens, and where intervals of equal ones begin in it.

    Prefix doubling: ranks after k rounds order the suffixes by 2**k tokens; two ranks
    that overlap reach LEAST. Neighbours share LEAST tokens unless an interval begins.
    """
    rank = np.unique(streams, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth * 2 <= LEAST:
        pair = rank[:-depth] * (rank.max() + 1 if len(rank) else 1) + rank[depth:]
        rank, depth = np.unique(pair, return_inverse=True)[1], depth * 2
    pair = rank[starts] * (rank.max() + 1 if len(rank) else 1) + rank[starts + LEAST - depth]
    order = np.argsort(pair, kind="stable")
    return order, np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0][: len(order)])


def interval_pages(order: np.ndarray, begins: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """For each start, whether its interval holds more than one page."""
    many = np.zeros(len(order), bool)
    if len(order):
        own = pages[order]
        mixed = np.minimum.reduceat(own, begins) < np.maximum.reduceat(own, begins)
        many[order] = np.repeat(mixed, np.diff(np.r_[begins, len(order)]))
    return many


def packed(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the tokens that the runs at the starts cover, and the starts among them."""
    covered = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + LEAST, -1)
    used = np.cumsum(covered)[:-1] > 0
    return tokens[used], (np.cumsum(used) - 1)[starts]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    """Slices of a few megabytes, their streams, and a hash of each page's host."""
    for row, end, _, _ in blocks(batch.column(2), 8 << 20):
        part = batch.slice(row, end - row)
        yield part, (*stream(part.column(2).to_pylist()), hosts_of(part.column(1), end - row))


def _key_rows(part: pa.RecordBatch, keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column(0).take(pa.array(rows))], names=["key", "page_id"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, (_, _, _, rows, h, host) in _slices(batch):
            at, key = anchors(h, rows)
            yield _key_rows(part, mix64(key ^ host[rows[at]]), rows[at])


class Keys:
    """Keys for the tasks: one broadcast array of at most HELD, else a column with each page's own."""

    def __init__(self, pages: DataFrame, found: DataFrame, rows: DataFrame, column: str, held: int):
        self.column, self.value = column, None
        if found.count() <= held:
            # as Arrow: eight bytes a key on the driver
            known = np.sort(found.toArrow().column(0).to_numpy().view(U64))
            self.value, self.pages = pages.sparkSession.sparkContext.broadcast(known), pages
        else:
            own = rows.join(found, "key", "left_semi").groupBy("page_id").agg(F.collect_set("key").alias(column))
            self.pages = pages.join(own, "page_id", "left").select(*pages.columns, column)
            self.pages = written(self.pages, column)

    def of(self, part: pa.RecordBatch) -> np.ndarray:
        if self.value is not None:
            return self.value.value
        return np.unique(np.asarray(part.column(part.schema.get_field_index(self.column)).flatten(), np.int64).view(U64))

    def __getstate__(self):
        return {"column": self.column, "value": self.value}


def _places(known: np.ndarray, h: np.ndarray, rows: np.ndarray, host: np.ndarray) -> np.ndarray:
    at, key = anchors(h, rows)
    return near(at[_in(known, mix64(key ^ host[rows[at]]))], rows)


def _digests(h: np.ndarray, starts: np.ndarray, hosts: np.ndarray) -> np.ndarray:
    digest = np.zeros(len(starts), U64)
    for k in range(LEAST if len(starts) else 0):
        digest = mix64(digest + h[starts + k])
    return mix64(digest ^ hosts)


def _class_rows(shared: Keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, (_, _, _, rows, h, host) in _slices(batch):
                # the streams of one host stand together
                order = np.argsort(host[rows], kind="stable")
                h, rows = h[order], rows[order]
                starts = _places(shared.of(part), h, rows, host)
                if not len(starts):
                    continue
                # one row for each interval and page: equal suffixes stand together, and theirs by page
                order, begins = suffix_array(*packed(h, starts))
                page = rows[starts[order]]
                new = np.r_[True, page[1:] != page[:-1]]
                new[begins] = True
                starts = starts[order[new]]
                yield _key_rows(part, _digests(h, starts, host[rows[starts]]), rows[starts])

    return run


def unique_runs(text: bytes, first: np.ndarray, last: np.ndarray, rows: np.ndarray, covered: np.ndarray, n: int) -> list[str]:
    """Each row's tokens that are not covered: tokens with a space between, runs with a line end between."""
    out, bounds = [], np.searchsorted(rows, np.arange(n + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        edges = np.flatnonzero(np.diff(np.r_[False, ~covered[a:b], False].astype(np.int8)))
        out.append("\n".join(b" ".join(text[first[a + i] : last[a + j - 1]].split()).decode() for i, j in zip(edges[::2], edges[1::2])))
    return out


def _covered(n: int, starts: np.ndarray) -> np.ndarray:
    """The tokens in the runs of LEAST that begin at the starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + LEAST, -1)
    return np.cumsum(change)[:n] > 0


def _result(ids: pa.Array, hosts: pa.Array, null: list[bool], text: bytes, first: np.ndarray, last: np.ndarray, rows: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    texts = unique_runs(text, first, last, rows, covered, n)
    counts = [pa.array(np.bincount(x, minlength=n)) for x in (rows, rows[covered])]
    return pa.RecordBatch.from_arrays([ids, hosts, pa.array([None if x else t for x, t in zip(null, texts)], pa.string()), *counts], names=["page_id", "host", "text", "n_tokens", "n_removed"])


def _extracted_rows(shared: Keys, repeats: Keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, (text, first, last, rows, h, host) in _slices(batch):
                named = np.asarray(part.column(0).is_valid(), dtype=bool)
                starts = _places(shared.of(part), h, rows, host)
                starts = starts[_in(repeats.of(part), _digests(h, starts, host[rows[starts]])) & named[rows[starts]]]
                yield _result(*part.columns[:2], part.column(2).is_null().to_pylist(), text, first, last, rows, _covered(len(h), starts))

    return run


def _packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, pages): pages of one host with their visible text, as a compressed Arrow stream."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        for row, end, _, _ in blocks(batch.column(2), BLOCK):
            part = batch.slice(row, end - row)
            seen = pa.array([None if p is None else visible(p) for p in part.column(2).to_pylist()], pa.string())
            table = pa.table([part.column(0), part.column(1), seen], names=["page_id", "host", "text"])
            names = table["host"].unique()
            hosts, out = [], []
            for name in names:
                own = table.filter(pc.equal(table["host"], name)).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=options) as stream_:
                    stream_.write_table(own)
                hosts.append(name.as_py())
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(out, pa.binary())], names=["host", "pages"])


def _sorted_hosts(table: pa.Table) -> pa.RecordBatch:
    """The results of whole hosts, from one array of all their suffixes; host and token make a symbol, so that no run crosses hosts."""
    table = table.combine_chunks()
    column = pc.fill_null(table["text"], "").combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else pc.fill_null(table["text"], "")
    _, _, data, offsets = next(blocks(column, 1 << 60), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    first, last, rows = word_spans(data, offsets, _TOKEN)
    host = table["host"].combine_chunks().dictionary_encode().indices.to_numpy().astype(U64)
    symbols = word_hashes(data, first, last) ^ mix64(host + U64(1))[rows]
    ids = table["page_id"].combine_chunks()
    named = np.asarray(ids.is_valid(), dtype=bool)
    page = np.unique(ids.fill_null(0).to_numpy(), return_inverse=True)[1]
    n = len(symbols) - LEAST + 1
    starts = np.flatnonzero((rows[:n] == rows[LEAST - 1 :]) & named[rows[:n]]) if n > 0 else np.zeros(0, np.int64)
    order, begins = suffix_array(symbols, starts)
    covered = _covered(len(symbols), starts[interval_pages(order, begins, page[rows[starts]])])
    return _result(ids, table["host"].combine_chunks(), table["text"].is_null().to_pylist(), data.tobytes(), first, last, rows, covered)


def _host_arrays(block: int):
    """Packages sorted by host to results: hosts are gathered until they fill a block; a host is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for host, pages in zip(batch.column(0), batch.column(1)):
                host = host.as_py()
                if size >= block and host != last:
                    yield _sorted_hosts(pa.concat_tables(held))
                    held, size = [], 0
                held.append(pa.ipc.open_stream(pages.as_buffer()).read_all())
                size, last = size + held[-1].nbytes, host
        if held:
            yield _sorted_hosts(pa.concat_tables(held))

    return run


def _repeated(rows: DataFrame, label: str) -> DataFrame:
    """The keys that two pages have."""
    both = rows.where("page_id is not null").groupBy("key").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"))
    return written(both.where("a <> b").select("key"), label)


ROWS = "key long, page_id long"
EXTRACTED = "page_id long, host string, text string, n_tokens long, n_removed long"


def of_small_hosts(pages: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """The results of hosts of which each fits a task; size: bytes of all pages."""
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * BLOCK)))
    packages = pages.mapInArrow(tidy(_packages), "host string, pages binary").repartition(n, "host").sortWithinPartitions("host")
    return packages.mapInArrow(tidy(_host_arrays(block)), EXTRACTED)


def of_large_hosts(pages: DataFrame, held: int = HELD) -> DataFrame:
    """The results of hosts of any size, from arrays of what each task has of them."""
    all_anchors = pages.mapInArrow(tidy(_anchor_rows), ROWS)
    shared = Keys(pages, _repeated(all_anchors, "anchors"), all_anchors, "anchors", held)
    classes = shared.pages.mapInArrow(tidy(_class_rows(shared)), ROWS)
    repeats = Keys(shared.pages, _repeated(classes, "repeats"), classes, "repeats", held)
    return repeats.pages.mapInArrow(tidy(_extracted_rows(shared, repeats)), EXTRACTED)


def extracted(pages: DataFrame, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """(page_id, host, text, n_tokens, n_removed) of every row: the runs that no other page of the host has."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    plain = lean(pages).select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))
    sizes = written(plain.groupBy("host").agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes")), "hosts")
    large = sizes.where(F.col("bytes") > block)
    total = sizes.agg(F.sum(F.when(F.col("bytes") <= block, F.col("bytes"))).alias("small"), F.count_if(F.col("bytes") > block).alias("large")).first()
    if not total.large:
        return of_small_hosts(plain, total.small or 0, block)
    large = small_side(large.select("host"), total.large)
    one = of_large_hosts(plain.join(large, "host", "left_semi").select("page_id", "host", "html"), held)
    if total.small is None:
        return one
    return one.unionByName(of_small_hosts(plain.join(large, "host", "left_anti").select("page_id", "host", "html"), total.small, block))
