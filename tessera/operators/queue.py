"""The processing queue, the cache and the life of documents, as changes of tables of the store.

A state is a row (doc_id, source_id, operation, status, attempts, priority, worker_id,
lease_expires_at, error_message, updated_at, anchor); a cached value is a row (namespace, key, value,
expires_at). Each change is one commit of the store, and a conflict with another worker's is raised.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.store import Store, last_of

# Priorities from the first to the last; seconds of delay per attempt, and at most.
PRIORITIES = ("urgent", "high", "normal", "low")
RETRY_SECONDS, MOST_RETRY_SECONDS = 5, 300
STATE = "doc_id long, source_id long, operation string, status string, attempts int, priority string, worker_id string, lease_expires_at timestamp, error_message string, updated_at timestamp, anchor string"


def due(now: Column) -> Column:
    """Whether a state may be claimed: pending, and where it failed before its delay is over, or processing with a lease that ran out."""
    delay = F.make_interval(secs=F.least(F.greatest(F.col("attempts"), F.lit(1)) * RETRY_SECONDS, F.lit(MOST_RETRY_SECONDS)))
    waited = (F.coalesce("error_message", F.lit("")) == "") | (F.col("updated_at") + delay <= now)
    return F.coalesce(((F.col("status") == "pending") & waited) | ((F.col("status") == "processing") & (F.col("lease_expires_at") <= now)), F.lit(False))


def claim_order() -> list[Column]:
    place = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    return [F.when(place > 0, place).otherwise(99), F.col("updated_at"), F.col("doc_id")]


class Queue:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path, ["doc_id"], "operation")

    def states(self) -> DataFrame:
        found = self.store.read()
        return self.spark.createDataFrame([], STATE) if found is None else found

    def enqueue(self, rows: DataFrame, now: datetime.datetime) -> None:
        """Makes rows (doc_id, source_id, operation, priority, anchor) pending; what is queued already keeps its source, priority and attempts."""
        old = self.states().select("doc_id", *(F.col(c).alias(f"old_{c}") for c in ("source_id", "priority", "attempts")))
        new = last_of(rows, ["doc_id"]).join(old, "doc_id", "left")
        self.store.upsert(
            new.select(
                "doc_id", F.coalesce("old_source_id", "source_id").alias("source_id"), "operation", F.lit("pending").alias("status"), F.coalesce("old_attempts", F.lit(0)).alias("attempts"),
                F.coalesce("old_priority", "priority").alias("priority"), F.lit(None).cast("string").alias("worker_id"), F.lit(None).cast("timestamp").alias("lease_expires_at"),
                F.lit(None).cast("string").alias("error_message"), F.lit(now).alias("updated_at"), "anchor",
            )
        )

    def claim(self, worker: str, now: datetime.datetime, n: int = 1, lease_seconds: int = 60) -> list[dict]:
        """Takes the first `n` states that are due, and returns them: as many as a worker asks for."""
        found = [r.asDict() for r in self.states().where(due(F.lit(now))).orderBy(*claim_order()).limit(n).collect()]
        if found:
            until = now + datetime.timedelta(seconds=max(lease_seconds, 1))
            changes = {"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "worker_id": F.lit(worker), "lease_expires_at": F.lit(until), "error_message": F.lit(None), "updated_at": F.lit(now)}
            self.store.update(F.col("doc_id").isin(*(r["doc_id"] for r in found)), changes)
        return found

    def _end(self, doc_ids: list[int], status: str, message: str | None, now: datetime.datetime) -> int:
        changes = {"status": F.lit(status), "worker_id": F.lit(None), "lease_expires_at": F.lit(None), "error_message": F.lit(message), "updated_at": F.lit(now)}
        return self.store.update(F.col("doc_id").isin(*doc_ids), changes)

    def complete(self, doc_ids: list[int], now: datetime.datetime) -> int:
        return self._end(doc_ids, "completed", None, now)

    def fail(self, doc_ids: list[int], message: str, now: datetime.datetime, retryable: bool = True) -> int:
        return self._end(doc_ids, "pending" if retryable else "failed", message, now)

    def process(self, worker: str, handle: Callable[[dict], None], anchors: DataFrame, now: datetime.datetime, n: int = 1) -> dict[int, str]:
        """Claims up to `n` states and handles each: how each ended, by doc_id.

        A state whose anchor isn't that of `anchors` (doc_id, anchor) any more is stale: something newer is
        or will be queued, and it is left as it is. A failure puts a state back, to be tried later.
        """
        claimed, ends = self.claim(worker, now, n), {}
        known = {r["doc_id"]: r["anchor"] for r in anchors.where(F.col("doc_id").isin(*(c["doc_id"] for c in claimed))).collect()} if claimed else {}
        for state in claimed:
            key = state["doc_id"]
            if state["anchor"] is not None and known.get(key) != state["anchor"]:
                ends[key] = "stale"
                continue
            try:
                handle(state)
            except Exception as error:  # whatever the handler raises is kept with the state
                self.fail([key], str(error) or type(error).__name__, now)
                ends[key] = "failed"
            else:
                self.complete([key], now)
                ends[key] = "completed"
        return ends


class Cache:
    """Values by namespace and key that may expire."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path, ["namespace", "key"], "namespace")

    def put(self, rows: DataFrame, now: datetime.datetime, seconds: int | None = None) -> None:
        """Stores rows (namespace, key, value), for so many seconds or for good."""
        until = F.lit(None if seconds is None else now + datetime.timedelta(seconds=seconds)).cast("timestamp")
        self.store.upsert(rows.select("namespace", "key", "value").withColumn("expires_at", until))

    def live(self, now: datetime.datetime, namespace: str | None = None) -> DataFrame | None:
        found = self.store.read()
        if found is None:
            return None
        live = found.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))
        return live if namespace is None else live.where(F.col("namespace") == namespace)

    def get(self, namespace: str, key: str, now: datetime.datetime) -> str | None:
        live = self.live(now, namespace)
        row = live.where(F.col("key") == key).first() if live is not None else None
        return row["value"] if row else None

    def purge(self, now: datetime.datetime) -> int:
        """Removes what has expired; returns how many."""
        found = self.store.read()
        if found is None:
            return 0
        return self.store.delete(found.where(F.col("expires_at") <= F.lit(now)).select("namespace", "key"))


# --- documents ---------------------------------------------------------------------------------


def activate_version(documents: Store, doc_id: int) -> int:
    """Makes a document the one active version of its group; returns how many rows changed. Without a group only its own row does."""
    row = documents.read().where(F.col("doc_id") == doc_id).select("version_group_id").first()
    if row is None:
        return 0
    group = F.col("doc_id") == doc_id if row[0] is None else F.col("version_group_id") == row[0]
    return documents.update(group, {"is_active": F.col("doc_id") == doc_id})


def deactivate(documents: Store, vectors: Store, queue: Queue, doc_id: int, now: datetime.datetime) -> str:
    """Hides a document, then deletes its vectors; if that fails, the deletion is queued. Returns deleted, queued or missing."""
    if not documents.update(F.col("doc_id") == doc_id, {"is_active": F.lit(False), "index_ready": F.lit(False)}):
        return "missing"
    gone = documents.spark.createDataFrame([(doc_id,)], "doc_id long")
    try:
        vectors.delete(gone)
    except Exception:  # the vectors' store may be away: the queue tries again
        queue.enqueue(gone.select("doc_id", F.lit(0).cast("long").alias("source_id"), F.lit("delete_document").alias("operation"), F.lit("high").alias("priority"), F.lit(None).cast("string").alias("anchor")), now)
        return "queued"
    return "deleted"


def sync_document(documents: Store, vectors: Store, rows: DataFrame, doc_id: int) -> None:
    """Puts a document's rows in place of all it had in the index, and shows it last, when they are there."""
    documents.update(F.col("doc_id") == doc_id, {"index_ready": F.lit(False)})
    own = rows.where(F.col("doc_id") == doc_id)
    if own.isEmpty():
        vectors.delete(documents.spark.createDataFrame([(doc_id,)], "doc_id long"))
    else:
        vectors.replace_documents(own)
    documents.update(F.col("doc_id") == doc_id, {"index_ready": F.lit(True)})


def migrate_tiers(documents: Store) -> int:
    """Moves documents to the tier that they should be in; returns how many moved."""
    from tessera.plans import policy

    wanted = policy.desired_tier(F.col("is_active"), F.col("index_ready"), F.col("status"))
    return documents.update(~F.col("tier").eqNullSafe(wanted), {"tier": wanted})
