"""What models and plans did: calls, texts, errors and milliseconds of each provider, and rows of each stage.

Calls are counted where they are made, in the task, and added up by an accumulator: a task's counts come to the driver
with its success, once, and those of an attempt that failed don't. A plan that is run twice counts twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import ship

Counts = dict[tuple[str, str], tuple[int, int, int, float]]
SCHEMA = "capability string, provider string, calls long, texts long, errors long, ms double"


class _Sums(AccumulatorParam):
    def zero(self, value: Counts) -> Counts:
        return {}

    def addInPlace(self, a: Counts, b: Counts) -> Counts:
        out = dict(a)
        for k, counts in b.items():
            out[k] = tuple(x + y for x, y in zip(out.get(k, (0, 0, 0, 0.0)), counts))
        return out


class _Watched:
    """A model whose methods are counted and timed: a list among the arguments is so many texts, else a call is one."""

    def __init__(self, model: Any, key: tuple[str, str], sums: Any):
        self._model, self._key, self._sums = model, key, sums

    def __getattr__(self, name: str) -> Any:
        found = getattr(self._model, name)
        if not callable(found):
            return found

        def call(*args, **kwargs):
            texts = next((len(a) for a in args if isinstance(a, (list, tuple))), 1)
            began, failed = time.perf_counter(), 1
            try:
                out = found(*args, **kwargs)
                failed = 0
                return out
            finally:
                self._sums.add({self._key: (1, texts, failed, (time.perf_counter() - began) * 1000)})

        return call


class Telemetry:
    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self._sums = spark, spark.sparkContext.accumulator({}, _Sums())
        self._stages: list[tuple[str, Observation]] = []

    def watched(self, factory: Callable[[], Any], capability: str, provider: str = "") -> Callable[[], Any]:
        """A factory of the same model for the functions of `hooks`, whose calls count as the provider's."""
        sums, key = self._sums, (capability, provider)
        return lambda: _Watched(factory(), key, sums)

    def report(self) -> DataFrame:
        """capability, provider, calls, texts, errors, ms of all tasks that have succeeded so far."""
        return self.spark.createDataFrame([(*k, *v) for k, v in sorted(self._sums.value.items())], SCHEMA)

    def reset(self) -> None:
        self._sums.value = {}

    def stage(self, df: DataFrame, name: str, **measures: Column) -> DataFrame:
        """df, whose rows are counted on their way as a stage of this name, and whatever else is measured of them."""
        seen = Observation()
        self._stages.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in measures.items()))

    def stages(self) -> list[dict[str, Any]]:
        """A record of each stage, in the order in which they were named; to be asked for after the plans have run."""
        return [{"stage": name, **seen.get} for name, seen in self._stages]
