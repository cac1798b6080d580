"""What the training-data operators share: session settings, table access and vectorised text scanning.

Text is scanned as UTF-8 bytes straight from Arrow buffers: a batch is one ``uint8`` array plus document
offsets, so no Python object is made per document unless an operator needs one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

#: Bytes of text that a vectorised step takes at once; its temporaries are about ten times as large.
CHUNK = 1 << 20
#: Half of what the tables of :func:`span_hashes` reach.
REACH = 1 << 18
MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(MULT), -1, 1 << 64))

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased.
_LETTERS = np.zeros(256, bool)
_LETTERS[0x30:0x3A] = _LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
#: Word bytes of ``[^\x20\x09-\x0D]+``.
_SOLID = np.ones(256, bool)
_SOLID[[0x20, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
LETTERS, SOLID, LOWER = _LETTERS, _SOLID, _LOWER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: int = 32 << 20) -> None:
    """Arrow batches of at most ``most`` bytes, so that long rows don't fill a Python worker; a smaller limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def give_back() -> None:
    """Hands freed memory back to the system: Python workers outlive their tasks, and what they keep counts for their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``)."""
    return shared_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder, so that losing an executor never loses the rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Partitions of at most about ``bytes_each`` on storage, and no fewer than the session asks for.

    A plan without a known size (not from files) has Spark's default of exabytes; the session decides there.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // bytes_each)) if size < 1 << 60 else least


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if column.null_count:  # a null may still own bytes
        null = column.is_null().to_numpy(zero_copy_only=False)
        lens = np.diff(off)
        if lens[null].any():
            buf = buf[np.repeat(~null, lens)]
            off = np.r_[0, np.cumsum(np.where(null, 0, lens))]
    return buf, off


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most ``limit`` bytes (one row at least): first row, end row, bytes, offsets."""
    buf, off = text_bytes(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(buf: np.ndarray, off: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes in ``words``, never across rows), and each row's first word (n + 1)."""
    w = words[buf]
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    at = off[:-1][np.diff(off) > 0]
    start[at] = w[at]
    last = off[1:][np.diff(off) > 0] - 1
    end[last] = w[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


_POW: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POW:
        for m in (MULT, _INV):
            p = np.full(2 * REACH + 1, m, np.uint64)
            p[0] = 1
            _POW.append(np.multiply.accumulate(p))
    return _POW


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the bytes stand."""
    out = np.zeros(len(starts), np.uint64)
    power, inverse = _powers()
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + 2 * REACH, "right"))
        if j <= i:  # a span longer than the tables: folded piece by piece
            h = 0
            for k in range(int(base), int(ends[i]), REACH):
                piece = buf[k : min(k + REACH, int(ends[i]))].astype(np.uint64) + np.uint64(1)
                h = (h * 1000003 + int((piece * power[: len(piece)]).sum())) & (2**64 - 1)
            out[i] = h
            i += 1
            continue
        part = buf[base : ends[j - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= power[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        out[i:j] = (total[ends[i:j] - base] - total[starts[i:j] - base]) * inverse[starts[i:j] - base]
        i = j
    return mix(out)


def planes(x: np.ndarray, width: int) -> bytes:
    """Integers as ``width`` little-endian byte planes; planes that are all zero compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def from_planes(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    """What :func:`planes` made."""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + count), one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
