"""Terms of whole texts as numbers, and joins with a small side whose size is checked."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import word_spans

#: A side of a join is broadcast up to so many rows and bytes of text; beyond, the join is salted.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 200_000, 32 << 20, 64

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
ALNUM = LETTERS.copy()
ALNUM[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def encoded(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word, the distinct words, where each text's words begin) for runs of the bytes
    that `kind` marks, with A-Z lower-cased. Words are equal as bytes, not by a hash."""
    solid = kind[data]
    start, end, firsts = word_spans(data, offs, solid)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    wide = ends[-1] >= 1 << 31
    make = pa.LargeStringArray if wide else pa.StringArray
    raw = np.ascontiguousarray(_LOWER[data[solid]])
    words = make.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64 if wide else np.int32)), pa.py_buffer(raw)).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.cast(pa.string()), firsts


def attached(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """big with the columns of small, which has one row per value of keys; rows without a match get nulls.

    A small side of a checked size is broadcast. A larger one is repeated for each of SALTS salts and the
    rows of big are dealt out over them, so a key that a third of all rows share is in many tasks.
    Null keys match nothing.
    """
    texts = [f.name for f in small.schema.fields if f.dataType.simpleString() in ("string", "array<string>")]
    length = sum((F.length(F.col(n) if small.schema[n].dataType.simpleString() == "string" else F.array_join(n, " ")) for n in texts), F.lit(0))
    size = small.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("b")).first()
    if size["n"] <= BROADCAST_ROWS and size["b"] <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), list(keys), "left")
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "__salt"], "left").drop("__salt")
