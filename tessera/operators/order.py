"""Places and quantiles in a total order, exact, without a window that holds all rows or a hot key in one task.

Rows are dealt out by ranges of (keys, order) and written once, with the number of their range. A key
that spans ranges is counted on by the counts of its earlier ranges; only the first key of a range can
have such, so there is at most one of these offsets per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.runtime import shared_path

_RANGE, _BEFORE, _WEIGHT, _UP_TO, _TOTAL = "__range", "__before", "__weight", "__up_to", "__total"


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df dealt out by ranges and read back from the shared folder: the numbers of ranges stay what they were."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "order")
    out = df.repartitionByRange(parts, *keys, *order).withColumn(_RANGE, F.spark_partition_id())
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _with_before(ranged: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """Adds the sum of weights of the same key in earlier ranges."""
    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, _RANGE).agg(F.sum(weight).alias(_WEIGHT))
    carried = sums.withColumn(_BEFORE, F.sum(_WEIGHT).over(earlier)).where(F.col(_BEFORE) > 0).drop(_WEIGHT)
    names = [*keys, _RANGE]
    right = carried.select(*(F.col(n).alias(f"__of_{n}") for n in names), _BEFORE)
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"__of_{n}"))
    # One row a range at most, so as many as there are shuffle partitions.
    joined = ranged.join(F.broadcast(right), same, "left")
    return joined.withColumn(_BEFORE, F.coalesce(_BEFORE, F.lit(0))).drop(*(f"__of_{n}" for n in names))


def numbered(df: DataFrame, name: str, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Adds a long column: the place of each row, from 1, in `order` among the rows of its keys (all rows without keys).

    Null keys are a key of their own and null values sort as `order` says; rows equal in all of
    `order` get different places, in any order. An empty table gives an empty one.
    """
    ranged = _with_before(_ranged(df, keys, order), keys, F.lit(1))
    here = F.row_number().over(Window.partitionBy(*keys, _RANGE).orderBy(*order))
    return ranged.withColumn(name, (here + F.col(_BEFORE)).cast("long")).drop(_RANGE, _BEFORE)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """keys and the smallest value that at least `share` of a key's values don't exceed.

    Equal values are counted before the shuffle and null values don't count; a key with none but null
    values has no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(_WEIGHT))
    ranged = _with_before(_ranged(counts, keys, [F.col(value)]), keys, F.col(_WEIGHT))
    up_to = F.col(_BEFORE) + F.sum(_WEIGHT).over(Window.partitionBy(*keys, _RANGE).orderBy(value))
    total = ranged.groupBy(*keys).agg(F.sum(_WEIGHT).alias(_TOTAL)).select(*(F.col(k).alias(f"__of_{k}") for k in keys), _TOTAL)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    reached = ranged.withColumn(_UP_TO, up_to).join(total, same).where(F.col(_UP_TO) >= F.ceil(F.col(_TOTAL) * share))
    return reached.groupBy(*keys).agg(F.min(value).alias(name))
