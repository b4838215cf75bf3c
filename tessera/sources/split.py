"""Records that may be bad: read permissively, and written in one pass as good and failed rows, each batch exactly once.

A batch is one write in a folder of its own, dealt by whether a row failed, and counts when the manifest names
it; so a batch that is repeated after a failure, or by a stream that starts again, adds nothing. Failed rows
keep what they were made of and why they failed, and can be tried again: a row that succeeds then is failed no more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.sources.store import Store

_CORRUPT = "__corrupt"


def checked(rows: DataFrame, text: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """rows with `record`, the JSON object in the column `text` as a struct of `schema`, and `error`, null where it is good.

    A text that is null, isn't one JSON object, or has a field that isn't of its type, is failed as a whole; so is one that
    lacks a required field, or has null or a blank text there. The record of a failed row is null.
    """
    parsed = F.from_json(F.col(text), f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    out = rows.withColumn("record", parsed)
    blank = lambda c: F.col(f"record.{c}").isNull() | (F.trim(F.col(f"record.{c}").cast("string")) == "")
    error = F.when(F.col(text).isNull(), "no text").when(F.col("record").isNull() | F.col(f"record.{_CORRUPT}").isNotNull() | ~F.ltrim(F.col(text)).startswith("{"), "not such an object")
    for name in required:
        error = error.when(blank(name), f"no {name}")
    names = [f.name for f in StructType.fromDDL(schema).fields]
    out = out.withColumn("error", error)
    return out.withColumn("record", F.when(F.col("error").isNull(), F.struct(*(F.col(f"record.{n}").alias(n) for n in names))))


class Split:
    """Good and failed rows of batches, by a key that says which rows are attempts at the same."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._log = Store(spark, self.path, [key], key)

    def done(self) -> list[str]:
        """Names of the batches that count."""
        return sorted(self._log._manifest()[1]["files"])

    def put(self, batch: int | str, rows: DataFrame) -> bool:
        """Writes a batch (key, error and other columns, the same in each batch); False if it was there already."""
        base, manifest = self._log._manifest()
        if str(batch) in manifest["files"]:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        out = rows.withColumn("attempt", F.lit(len(manifest["files"])))
        out.withColumn("__failed", F.col("error").isNotNull()).write.partitionBy("__failed").parquet(f"{self.path}/{folder}")
        self._log._commit(base, out.schema, {**manifest["files"], str(batch): [folder]})
        return True

    def _rows(self, failed: bool) -> DataFrame | None:
        _, manifest = self._log._manifest()
        if not manifest["schema"]:
            return None
        schema = StructType.fromJson(manifest["schema"]).add("__failed", "boolean")
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for own in manifest["files"].values() for f in own]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where(F.col("__failed") == failed).drop("__failed")

    def good(self) -> DataFrame | None:
        """Rows without an error, the first attempt of each key that had none."""
        rows = self._rows(False)
        return rows if rows is None else _first(rows, self.key, F.col("attempt")).drop("error")

    def failed(self) -> DataFrame | None:
        """The last attempt of each key that has no good row."""
        rows = self._rows(True)
        return rows if rows is None else _first(rows.join(self._rows(False).select(self.key).distinct(), self.key, "left_anti"), self.key, F.col("attempt").desc())

    def remaining(self, rows: DataFrame) -> DataFrame:
        """Those of rows that no batch has yet, good or failed: where a run that was broken off goes on."""
        if not self.done():
            return rows
        return rows.join(self._rows(False).select(self.key).union(self._rows(True).select(self.key)).distinct(), self.key, "left_anti")

    def retry(self, batch: int | str, attempt: Callable[[DataFrame], DataFrame]) -> bool:
        """Puts what `attempt` makes of the failed rows (without error and attempt) as a batch."""
        rows = self.failed()
        return rows is not None and self.put(batch, attempt(rows.drop("error", "attempt")))

    def follow(self, stream: DataFrame, checkpoint: str, attempt: Callable[[DataFrame], DataFrame]):
        """Puts each micro-batch of a stream, once."""
        return stream.writeStream.foreachBatch(lambda df, n: self.put(f"stream-{n:012d}", attempt(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _first(rows: DataFrame, key: str, order) -> DataFrame:
    by = Window.partitionBy(key).orderBy(order, F.to_json(F.struct(*rows.columns)))
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
