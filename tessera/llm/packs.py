"""Packs: some MB of whole texts in one row, compressed, and messages between packs and hash buckets.

A pack asks or tells each bucket once, in one row, so what many documents of a pack have in common
is one entry of one message, and a task holds one bucket or one pack at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import blocks

PACK = 1 << 22
LAST = np.iinfo(np.int64).max
#: A bucket gets the messages of so many packs' worth of entries, so it doesn't grow with the corpus.
PACKS_PER_BUCKET = 4
FEW_PACKS = 8


def bucket_count(packs: DataFrame) -> int:
    """How many buckets the messages of all packs go to, one for each of a few packs. The results don't depend on it."""
    n = packs.count()
    return max(1, min(n, FEW_PACKS), -(-n // PACKS_PER_BUCKET))



def pack(docs: DataFrame, size: int = PACK) -> DataFrame:
    """Rows of packs: pack, ids (null last of all: the largest long), offs, texts (zstandard), rows (all columns but text)."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = zstandard.ZstdCompressor(level=3), 0
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64()).fill_null(LAST)
            others = pa.StructArray.from_arrays([b.column(c) for c in rest], fields=[b.schema.field(c) for c in rest])
            for lo, hi, data, offs in blocks(b.column("text"), size):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([TaskContext.get().partitionId() << 32 | n], pa.int64()),
                        pa.array([ids[lo:hi].to_pylist()], pa.list_(pa.int64())),
                        pa.array([offs.tolist()], pa.list_(pa.int64())),
                        pa.array([z.compress(data.tobytes())], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.concat_arrays([others[lo:hi]])),
                    ],
                    names=["pack", "ids", "offs", "texts", "rows"],
                )
                n += 1

    kinds = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select("text", *rest).mapInArrow(run, f"pack long, ids array<long>, offs array<long>, texts binary, rows array<struct<{kinds}>>")


def unpack(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array(b.column("ids")[k].as_py(), np.int64)
    offs = np.array(b.column("offs")[k].as_py(), np.int64)
    return ids, offs, np.frombuffer(zstandard.decompress(b.column("texts")[k].as_py()) if offs[-1] else b"", np.uint8)


def bucketwise(batches: Iterable[pa.RecordBatch], work: Callable[[int, list[dict]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls work with all rows of a bucket, from rows that are sorted by bucket."""
    bucket, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != bucket and held:
                yield from work(bucket, held)
                held = []
            bucket = r["bucket"]
            held.append(r)
    if held:
        yield from work(bucket, held)
