"""Shared building blocks of the text operators.

All heavy work is vectorised over the UTF-8 buffer of an Arrow column.  A batch
is cut into chunks of bounded bytes, so memory does not depend on how long the
texts of one partition are together; a single longer text is one chunk, unless `pieces` cuts it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.store import cut as cut

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Bytes of text that one vectorised step works on (a longer text is one step).
CHUNK_BYTES = 1 << 18

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept and grown by doubling."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that hashes can be compared, ordered and bucketed."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def random_table(seed: int, size: int = 256) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, size, dtype=np.uint64) * U64(2) + U64(1)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i; range_hash reads any range from them."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of [start, end): equal ranges have equal hashes."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    a = column.cast(pa.large_binary())
    _, offs, data = a.buffers()
    n = len(a)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, dtype=np.int64)[a.offset : a.offset + n + 1]
    b = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    if a.null_count:
        lens = np.where(np.asarray(a.is_valid()), np.diff(o), 0)
        if lens.sum() != len(b):
            b = np.concatenate([np.zeros(0, np.uint8), *(b[s - o[0] : s - o[0] + k] for s, k in zip(o[:-1], lens) if k)])
        return b, np.concatenate([[0], np.cumsum(lens)])
    return b, o - o[0]


def chunked(batch: pa.RecordBatch, text: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most max_bytes together, or one row."""
    lens = pc.binary_length(batch.column(text).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(lens):
        n = max(1, int(np.searchsorted(np.cumsum(lens[at:]), max_bytes, side="right")))
        yield batch.slice(at, n)
        at += n


def pieces(column: pa.Array, overlap: int, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, n + 1 offsets, row of each text, where it begins in that row's text) of texts with at most max_bytes together.

    A longer text comes in pieces that share `overlap` bytes, so every stretch of overlap + 1 bytes lies in one of them, and all
    but the last `overlap` bytes of a piece begin such a stretch that no other piece begins."""
    lens = pc.binary_length(column.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(lens):
        n = max(1, int(np.searchsorted(np.cumsum(lens[at:]), max_bytes, side="right")))
        buf, offs = utf8(column.slice(at, n))
        if len(buf) <= max_bytes:
            yield buf, offs, np.arange(at, at + n), np.zeros(n, np.int64)
        else:
            for start in range(0, max(1, len(buf) - overlap), max_bytes):
                part = buf[start : start + max_bytes + overlap]
                yield part, np.array([0, len(part)]), np.array([at]), np.array([start])
        at += n


def word_bounds(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, which never cross texts, and each text's first word."""
    mask = is_word[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offs] = True
    edge = np.empty(len(buf) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    if len(buf):
        edge[1:-1] = mask[1:] != mask[:-1]
    edge |= cut
    at = np.flatnonzero(edge)
    keep = mask[at[:-1]] if len(buf) else np.zeros(0, bool)
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, offs)


def byte_set(spans: list[tuple[int, int]], inverted: bool = False) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return ~out if inverted else out


def lower_values(seed: int) -> np.ndarray:
    """A random value for each byte, the same for A-Z as for a-z."""
    t = random_table(seed)
    t[0x41:0x5B] = t[0x61:0x7B]
    return t


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def bounded_sample(rows: DataFrame, bound: int, *by: str) -> DataFrame:
    """At most `bound` rows in expectation, chosen by the hash of columns `by`, each value of them once; all values if there are no
    more rows.  A value that repeats passes once or not at all, so repeats do not exceed the bound."""
    n = rows.count()
    if n > bound:
        wide = 1 << 30
        rows = rows.where(F.pmod(F.xxhash64(*by), F.lit(wide)) < F.lit(max(1, wide * bound // n)))
    return rows.dropDuplicates(list(by))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of input after which a worker gives unused memory back.
RELEASE_BYTES = 1 << 24
#: Rows that a Python worker gets at once: texts are long rows.
BATCH_ROWS = 200


def released() -> None:
    """Gives memory that is no longer used back to the system: a worker lives on after its task, beside those of other tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """rows.mapInArrow(run, schema) with bounded memory: all operators send Python BATCH_ROWS rows at once at most
    (a setting of the session, and the same for all of them), and a worker gives memory back after each RELEASE_BYTES and at its end."""

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for batch in batches:
                size += batch.nbytes
                if size >= RELEASE_BYTES:
                    released()
                    size = 0
                yield batch

        try:
            yield from run(counted())
        finally:
            released()

    return small_batches(rows).mapInArrow(frugal, schema)


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """The same rows; from now on the session sends Python at most `rows` rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, rows)
    return df
