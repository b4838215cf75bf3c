"""What the operators share: tables in the shared folder and a numpy kernel over UTF-8 buffers.

Kernel functions work on a block: the bytes of some whole texts, one after another (`data`), and
`offs`, where each begins, with the end of the last one added. A block holds a few MB unless one
text alone is longer, so memory doesn't depend on how many rows an Arrow batch has.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import ship, spread

BLOCK = 1 << 19
WORD = "[^\\x20\\x09-\\x0D]+"


# --- tables in the shared folder ---------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a folder of our own in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share with the driver")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: later stages neither repeat
    its work nor depend on the executors that did it."""
    ship(df.sparkSession)
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that are done: it does so once the
    JVM has collected their handles, which an idle driver may not do for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, mod n; a null id gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def release() -> None:
    """Gives freed memory back to the system: an executor's idle workers would keep it from its busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


# --- UTF-8 blocks ------------------------------------------------------------------------------


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offs) of runs of whole texts of about `limit` bytes at most."""
    data, offs = buffers(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    release()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(0x7E55E2A)
_RAW = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _RAW[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2**64, and those of its inverse."""
    if len(_powers[0]) < n:
        m = max(n, BLOCK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray, fold: bool) -> np.ndarray:
    """Running polynomial sums; span_hash takes the hash of any span from them."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.multiply((_FOLDED if fold else _RAW)[data], powers(len(data))[0][: len(data)], out=c[1:])
    np.cumsum(c, out=c)
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * powers(len(c))[1][start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offs: np.ndarray, solid: np.ndarray | None = None, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each text's words begin (with their total added).

    `solid` marks the bytes of words; without it they are all but ASCII white space. `alone` marks
    the bytes of characters that are words by themselves."""
    solid = ~_SPACE[data] if solid is None else solid
    begins, ends = solid.copy(), solid.copy()
    if len(data):
        edge = ~solid[:-1]
        if alone is not None:  # a character that is a word begins at its leading byte, what follows it too
            edge |= (alone[1:] | alone[:-1]) & ((data[1:] & 0xC0) != 0x80)
        begins[1:] &= edge
        ends[:-1] &= ~solid[1:] | begins[1:]
        full = offs[1:] > offs[:-1]
        first, last = offs[:-1][full], offs[1:][full] - 1
        begins[first] = solid[first]
        ends[last] = solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offs)


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of n values in a row from each position on that has them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def owner(firsts: np.ndarray) -> np.ndarray:
    """The text each element belongs to, from where each text's elements begin."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def sum_by(values: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(who, weights=values, minlength=n).astype(np.int64)
