"""Bitmaps of attributes: which rows a condition lets through, before anything else of them is read.

Rows have positions from 1. For each value of an attribute and each bucket of 32,768 positions there
is one bitmap of 4 KB, made by Spark's own aggregate. Conditions are built of `among`, `listed`,
`all_of`, `any_of` and `none_of`; each is a table (bucket, bits) and costs a shuffle of bitmaps, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import numbered

_BYTES = 4096
#: Buckets up to which bitmaps are broadcast to the rows they filter: 32 MB.
BROADCAST_BUCKETS = 8192


def positions(rows: DataFrame, key: str) -> DataFrame:
    """rows with a position of each, from 1 and without gaps, in the order of key."""
    return numbered(rows, "position", [F.col(key)])


def _collected(rows: DataFrame, *by: str) -> DataFrame:
    at = rows.withColumn("bucket", F.bitmap_bucket_number("position"))
    return at.groupBy(*by, "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bits"))


def bitmap_index(rows: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """attribute, value (as a string; null is a value), bucket, bits of rows with positions; to be written by attribute.

    The attribute '' has one value, null, that all rows have.
    """
    pairs = F.array(F.struct(F.lit("").alias("attribute"), F.lit(None).cast("string").alias("value")), *(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes))
    return _collected(rows.select("position", F.inline(pairs)), "attribute", "value")


def among(index: DataFrame, attribute: str, values: Sequence) -> DataFrame:
    """Rows whose attribute has one of values; None stands for null."""
    plain = [str(v) if not isinstance(v, bool) else str(v).lower() for v in values if v is not None]
    hit = F.col("value").isin(plain) | (F.col("value").isNull() if None in values else F.lit(False))
    return index.where((F.col("attribute") == attribute) & hit).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def listed(placed: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows (with positions) whose key is in ids, a table of any length."""
    return _collected(placed.select("position", key).join(ids.select(key).distinct(), key, "left_semi"))


def any_of(*conditions: DataFrame) -> DataFrame:
    """Rows that meet one of conditions."""
    out = conditions[0]
    for c in conditions[1:]:
        out = out.union(c)
    return out.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def all_of(*conditions: DataFrame) -> DataFrame:
    """Rows that meet all of conditions; a bucket that one of them hasn't has no such rows."""
    out = conditions[0]
    for c in conditions[1:]:
        out = out.union(c)
    return out.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(conditions)).drop("n")


def none_of(index: DataFrame, condition: DataFrame) -> DataFrame:
    """Rows of the index that don't meet a condition."""
    every = among(index, "", [None])
    both = every.join(condition.withColumnRenamed("bits", "out"), "bucket", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                own = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8)
                out = np.frombuffer(b"".join(x or bytes(_BYTES) for x in part.column("out").to_pylist()), np.uint8)
                left = (own & ~out).reshape(-1, _BYTES)
                yield pa.RecordBatch.from_arrays([part.column("bucket"), pa.array([r.tobytes() for r in left], pa.binary())], names=["bucket", "bits"])

    return both.mapInArrow(run, "bucket long, bits binary")


def how_many(condition: DataFrame) -> int:
    return condition.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]


def chosen(placed: DataFrame, condition: DataFrame) -> DataFrame:
    """The rows (with positions) that meet a condition. A bucket without a bit is joined with nothing."""
    found = condition.where(F.bitmap_count("bits") > 0)
    small = found.count() <= BROADCAST_BUCKETS
    at = F.bitmap_bit_position("position")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = placed.withColumn("bucket", F.bitmap_bucket_number("position")).join(F.broadcast(found) if small else found, "bucket")
    return joined.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0).select(*placed.columns)
