"""Shared pieces of the corpus operators: shared storage, text buffers, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written  # noqa: F401

#: Bytes of text handled at once inside one Arrow batch.
BLOCK_BYTES = 1 << 19
#: Rows a side may have at most to be broadcast; above it Spark shuffles both sides.
BROADCAST_ROWS = 2_000_000

#: Rows of text that go to a Python worker at once, at most.
BATCH_ROWS = 1000

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: ASCII letters and digits, and every byte of a multi-byte character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def release() -> None:
    """Gives memory that a worker has used and let go back to the system: workers live on and wait."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function over a partition's batches that releases memory as it goes and when it ends."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, out in enumerate(run(batches)):
            yield out
            if k % 16 == 15:
                release()
        release()

    return wrapped


def lean(df: DataFrame) -> DataFrame:
    """df; its session hands at most BATCH_ROWS rows to Python at once, so that batches of long texts stay small."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side of so many narrow rows, if that is few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(docs: DataFrame) -> Column:
    """A hash of id and text: what tells documents apart, also those that share an id or have none."""
    return F.xxhash64(F.lit(7), docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["doc_id"].isNull())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1) and validity of a string column, without copying."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    _, at, data = column.buffers()
    offsets = np.zeros(n + 1, np.int64)
    if n:
        offsets = np.frombuffer(at, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid(), dtype=bool) if column.null_count else np.ones(n, bool)
    return raw, offsets, valid


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about `most` bytes."""
    raw, offsets, _ = utf8(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        most = max(n, BLOCK_BYTES + 1)
        for k, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(most, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; no run crosses rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    counts = np.searchsorted(first, offsets)
    return first, last, np.repeat(np.arange(len(offsets) - 1), np.diff(counts))


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes."""
    if not len(first):
        return np.zeros(0, U64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up, out=sums[1:])
    return mix64((sums[last] - sums[first]) * down[first] + (last - first).astype(U64))


def hash_text(word: str) -> int:
    """word_hashes() of one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])
