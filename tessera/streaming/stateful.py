"""Limiter, breaker and leases over streams: the rules of `guards`, with their state kept by Spark between micro-batches.

Rows of a key count in the order of time and id within a micro-batch, and batches in the order they come; so
a stream whose batches follow each other in time gives what the batch folds give, across restarts too.
A timer in event time drops the state of a key that can't matter any more: a limiter's when its window has passed, a
closed breaker's without failures at once, a lease's when it has run out, which is told as a row. State is in RocksDB.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.runtime import ship
from tessera.streaming.guards import Breaker, Limiter

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sorted(rows: Iterator[pd.DataFrame]) -> Iterator:
    """Rows of one key in one micro-batch by time and id, with seconds as `now`."""
    found = pd.concat(list(rows), ignore_index=True)
    found["now"] = found["at"].astype("datetime64[us]").astype("int64") / 1e6
    return found.sort_values(["now", "event_id"], kind="stable").itertuples(index=False)


def _only_timer(handle: StatefulProcessorHandle, milliseconds: int) -> None:
    for old in list(handle.listTimers()):
        handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
    handle.registerTimer(milliseconds)


class _Limit(StatefulProcessor):
    def __init__(self, window: float, most: int):
        self.window, self.most = window, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.allowed = handle, handle.getListState("allowed", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        limiter = Limiter(self.window, self.most)
        limiter.allowed = deque(sorted(r[0] for r in self.allowed.get()) if self.allowed.exists() else ())
        out = [(r.event_id, limiter.allow(r.now)) for r in _sorted(rows)]
        if limiter.allowed:
            self.allowed.put([(t,) for t in limiter.allowed])
            _only_timer(self.handle, int((limiter.allowed[-1] + self.window) * 1000) + 1)
        else:
            self.allowed.clear()
        event_id, allowed = zip(*out)
        yield pd.DataFrame({"user_id": key[0], "event_id": event_id, "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.allowed.clear()
        return iter(())

    def close(self) -> None:
        pass


_BREAKER = ("state", "failed", "succeeded", "probed", "opened")


class _Break(StatefulProcessor):
    def __init__(self, config: dict):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "state string, failed int, succeeded int, probed int, opened double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = dict(zip(_BREAKER, self.state.get())) if self.state.exists() else {}
        breaker, out = Breaker(**self.config, **kept), []
        for r in _sorted(rows):
            out.append((r.event_id, breaker.call(r.now, bool(r.ok)), breaker.state))
        if breaker.state == "closed" and not breaker.failed:
            self.state.clear()
        else:
            self.state.update(tuple(getattr(breaker, f) for f in _BREAKER))
        event_id, passed, state = zip(*out)
        yield pd.DataFrame({"circuit": key[0], "event_id": event_id, "passed": passed, "state": state})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


@dataclass
class Lease:
    """Who works on an item: `claim` takes it where nobody's lease runs, `renew`, `complete` and `fail` are the holder's; an item fails for good after `attempts`."""

    seconds: float = 300.0
    most: int = 3
    status: str = "pending"
    worker: str | None = None
    until: float = 0.0
    attempts: int = 0

    def event(self, now: float, kind: str, worker: str | None) -> bool:
        """Whether the event counts; if so it moves the state."""
        held = self.status == "processing" and now < self.until
        if kind == "enqueue":
            if held or self.status == "pending":
                return False
            self.status, self.worker, self.until, self.attempts = "pending", None, 0.0, 0
            return True
        if kind == "claim":
            if held or self.status in ("done", "failed") or self.attempts >= self.most:
                return False
            self.status, self.worker, self.until, self.attempts = "processing", worker, now + self.seconds, self.attempts + 1
            return True
        if not held or worker != self.worker:
            return False
        if kind == "renew":
            self.until = now + self.seconds
        elif kind == "complete":
            self.status, self.worker, self.until = "done", None, 0.0
        elif kind == "fail":
            self.status, self.worker, self.until = "failed" if self.attempts >= self.most else "pending", None, 0.0
        else:
            return False
        return True


_LEASE = ("status", "worker", "until", "attempts")


class _Hold(StatefulProcessor):
    def __init__(self, config: dict):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("lease", "status string, worker string, until double, attempts int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lease = Lease(**self.config, **(dict(zip(_LEASE, self.state.get())) if self.state.exists() else {}))
        out = [(r.event_id, lease.event(r.now, r.kind, r.worker), lease.status, lease.worker) for r in _sorted(rows)]
        self.state.update(tuple(asdict(lease)[f] for f in _LEASE))
        if lease.status == "processing":
            _only_timer(self.handle, int(lease.until * 1000))
        event_id, counts, status, worker = zip(*out)
        yield pd.DataFrame({"item_id": key[0], "event_id": pd.array(event_id, dtype="Int64"), "counts": counts, "status": status, "worker": worker})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = dict(zip(_LEASE, self.state.get())) if self.state.exists() else {}
        if kept.get("status") == "processing" and kept["until"] * 1000 <= timerValues.getCurrentWatermarkInMs():
            yield pd.DataFrame({"item_id": [key[0]], "event_id": pd.array([None], dtype="Int64"), "counts": [True], "status": ["expired"], "worker": [kept["worker"]]})

    def close(self) -> None:
        pass


def _kept(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    spark = stream.sparkSession
    ship(spark)
    if spark.conf.get(_PROVIDER, "") != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)  # what keeps lists and timers
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def limit_stream(events: DataFrame, window: float = 60.0, most: int = 60) -> DataFrame:
    """user_id, event_id, allowed of a stream (user_id long, event_id long, at timestamp with a watermark); a user's state is `most` times."""
    return _kept(events.select("user_id", "event_id", "at"), "user_id", _Limit(window, most), "user_id long, event_id long, allowed boolean")


def break_stream(calls: DataFrame, **config) -> DataFrame:
    """circuit, event_id, passed, state of a stream (circuit long, event_id long, at timestamp with a watermark, ok boolean); config as Breaker's."""
    unknown = set(config) - {f.name for f in fields(Breaker)[:4]}
    if unknown:
        raise TypeError(f"a breaker has no {', '.join(sorted(unknown))}")
    return _kept(calls.select("circuit", "event_id", "at", "ok"), "circuit", _Break(config), "circuit long, event_id long, passed boolean, state string")


def lease_stream(events: DataFrame, seconds: float = 300.0, most: int = 3) -> DataFrame:
    """item_id, event_id, counts, status, worker of a stream (item_id long, event_id long, at timestamp with a watermark, kind, worker).

    kind is enqueue, claim, renew, complete or fail. When the watermark passes the end of a lease that is
    held, a row without event_id tells that it has expired; the next claim then takes the item.
    """
    return _kept(events.select("item_id", "event_id", "at", "kind", "worker"), "item_id", _Hold({"seconds": seconds, "most": most}), "item_id long, event_id long, counts boolean, status string, worker string")
