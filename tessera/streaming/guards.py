"""Stateful operators over time: each works on sorted rows of a key as a stream, in batch or from a stream.

The functions take rows of one key in order and yield what happens, with state of a fixed size, so a
key of any length passes through. `in_order` deals rows by key and sorts them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import ship


@dataclass
class Limiter:
    """Sliding window: a request is allowed while fewer than `most` allowed ones are in the window; refused ones don't count."""

    window: float = 60.0
    most: int = 60

    def __post_init__(self):
        self.allowed: deque[float] = deque()

    def allow(self, now: float) -> bool:
        while self.allowed and self.allowed[0] < now - self.window:
            self.allowed.popleft()
        if len(self.allowed) >= self.most:
            return False
        self.allowed.append(now)
        return True


@dataclass
class Breaker:
    """closed, open after `failures` in a row, half-open after `cooldown`: then `probes` calls may pass, and `successes` of them close it."""

    failures: int = 5
    cooldown: float = 30.0
    probes: int = 1
    successes: int = 2
    state: str = "closed"
    failed: int = 0
    succeeded: int = 0
    probed: int = 0
    opened: float = 0.0

    def call(self, now: float, ok: bool) -> bool:
        """Whether the call passes; if so, its outcome moves the state."""
        if self.state == "open":
            if now - self.opened < self.cooldown:
                return False
            self.state, self.probed, self.succeeded = "half_open", 0, 0
        if self.state == "half_open":
            if now - self.opened >= self.cooldown:
                self.probed, self.opened = 0, now
            if self.probed >= self.probes:
                return False
            self.probed += 1
        self._outcome(now, ok)
        return True

    def _outcome(self, now: float, ok: bool) -> None:
        if self.state == "half_open":
            if not ok:
                self.state, self.opened, self.failed, self.probed = "open", now, self.failures, 0
                return
            self.succeeded += 1
            if self.succeeded >= self.successes:
                self.state, self.failed, self.succeeded, self.probed = "closed", 0, 0, 0
        elif ok:
            self.failed = 0
        else:
            self.failed += 1
            if self.failed >= self.failures:
                self.state, self.opened = "open", now


def in_order(df: DataFrame, key: str, order: list[str], fold: Callable[[Iterator[dict]], Iterator[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Applies `fold` to the rows of each key in order. Rows stream through; a key isn't gathered."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        held: list[dict] = []
        for _, own in groupby(rows, key=lambda r: r[key]):
            for out in fold(own):
                held.append(out)
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def limit_rate(events: DataFrame, window: float = 60.0, most: int = 60, everybody: int | None = None) -> DataFrame:
    """user_id, event_id, allowed of events (user_id, event_id, at in seconds), per user.

    With `everybody` no more than so many requests of all users together are allowed in a window. That
    rule depends on every request before it, so it is one fold over all events in one task; its state
    is `everybody` times and what each user has in the window.
    """
    arrow = pa.schema([("user_id", pa.int64()), ("event_id", pa.int64()), ("allowed", pa.bool_())])
    if everybody is not None:

        def all_in_order(rows):
            own, every = {}, Limiter(window, everybody)
            for r in rows:
                while every.allowed and every.allowed[0] < r["at"] - window:
                    every.allowed.popleft()
                limiter = own.setdefault(r["user_id"], Limiter(window, most))
                allowed = len(every.allowed) < everybody and limiter.allow(r["at"])
                if allowed:
                    every.allowed.append(r["at"])
                yield {"user_id": r["user_id"], "event_id": r["event_id"], "allowed": allowed}
                if len(own) > 4 * everybody:  # users without a request in the window have no state
                    own = {u: x for u, x in own.items() if x.allowed and x.allowed[-1] >= r["at"] - window}

        one = events.select("user_id", "event_id", "at").withColumn("__all", F.lit(0))
        return in_order(one, "__all", ["at", "event_id"], all_in_order, "user_id long, event_id long, allowed boolean", arrow)

    def fold(rows):
        limiter = Limiter(window, most)
        for r in rows:
            yield {"user_id": r["user_id"], "event_id": r["event_id"], "allowed": limiter.allow(r["at"])}

    return in_order(events.select("user_id", "event_id", "at"), "user_id", ["at", "event_id"], fold, "user_id long, event_id long, allowed boolean", arrow)


def break_circuits(calls: DataFrame, **config) -> DataFrame:
    """circuit, event_id, passed, state (after the call) of calls (circuit, event_id, at in seconds, ok)."""

    def fold(rows):
        breaker = Breaker(**config)
        for r in rows:
            passed = breaker.call(r["at"], r["ok"])
            yield {"circuit": r["circuit"], "event_id": r["event_id"], "passed": passed, "state": breaker.state}

    arrow = pa.schema([("circuit", pa.int64()), ("event_id", pa.int64()), ("passed", pa.bool_()), ("state", pa.string())])
    return in_order(calls.select("circuit", "event_id", "at", "ok"), "circuit", ["at", "event_id"], fold, "circuit long, event_id long, passed boolean, state string", arrow)
