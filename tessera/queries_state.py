"""Queries of state over time, on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.operators.order import numbered
from tessera.streaming import events as E
from tessera.streaming import guards


def _at(spark, sf):
    return table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query("rate_limiter")
def rate_limiter(spark, sf):
    """Three requests an hour for each user: the rest is refused and doesn't count."""
    return guards.limit_rate(_at(spark, sf), 3600.0, 3)


@query("circuit_breaker")
def circuit_breaker(spark, sf):
    """Errors are failures; a circuit for every tenth user."""
    calls = _at(spark, sf).select((F.col("user_id") % 10).alias("circuit"), "event_id", "at", (F.col("event_type") != "error").alias("ok"))
    return guards.break_circuits(calls, failures=2, cooldown=600.0)


_PRIORITY = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 99 END"


def _priority():
    e = F.col("event_type")
    return F.when(e == "error", 0).when(e == "purchase", 1).when(e == "view", 2).otherwise(99)


@query("claim_order", f"SELECT user_id AS queue, event_id, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_PRIORITY}, ts, event_id) AS r FROM events)")
def claim_order(spark, sf):
    """The place of every task in its queue; a long queue is dealt over many tasks."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("queue"), "event_id", "ts", _priority().alias("priority"))
    placed = numbered(e, "place", [F.col("priority"), F.col("ts"), F.col("event_id")], ["queue"])
    return placed.select("queue", "event_id", F.col("place").cast("int").alias("place"))


@query(
    "lease_claim",
    f"""WITH s AS (SELECT *, event_id % 4 AS attempts, CASE event_type WHEN 'click' THEN ts + INTERVAL 10 MINUTE END AS lease, max(ts) OVER () AS now FROM events),
a AS (SELECT * FROM s WHERE (event_type IN ('error', 'purchase', 'view') AND ts + to_seconds(least(5 * greatest(attempts, 1), 300)) <= now) OR lease <= now)
SELECT queue, event_id, attempts + 1 AS attempts FROM (SELECT user_id AS queue, *, row_number() OVER (PARTITION BY user_id ORDER BY {_PRIORITY}, ts, event_id) AS r FROM a) WHERE r = 1""",
)
def lease_claim(spark, sf):
    """The next task of each queue: what is pending and past its backoff, or whose lease has run out."""
    e = _at(spark, sf).withColumn("attempts", F.col("event_id") % 4)
    now = e.agg(F.max("at").alias("now"))
    e = e.crossJoin(F.broadcast(now))
    pending = F.col("event_type").isin("error", "purchase", "view") & (F.col("at") + F.least(5 * F.greatest("attempts", F.lit(1)), F.lit(300)) <= F.col("now"))
    expired = (F.col("event_type") == "click") & (F.col("at") + 600 <= F.col("now"))
    free = e.where(pending | expired).groupBy(F.col("user_id").alias("queue")).agg(F.min(F.struct(_priority().alias("priority"), "ts", "event_id", "attempts")).alias("first"))
    return free.select("queue", "first.event_id", (F.col("first.attempts") + 1).alias("attempts"))


@query(
    "ttl_cache",
    """WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id AS namespace, event_type AS key, event_id AS value FROM l, n WHERE r = 1 AND (event_type = 'signup' OR ts + INTERVAL 2 DAY > now)""",
)
def ttl_cache(spark, sf):
    """The newest entry of each key, unless it has expired; sign-ups never do."""
    e = _at(spark, sf)
    newest = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "at")).alias("x"))
    live = newest.crossJoin(F.broadcast(e.agg(F.max("at").alias("now")))).where((F.col("event_type") == "signup") | (F.col("x.at") + 2 * 86400 > F.col("now")))
    return live.select(F.col("user_id").alias("namespace"), F.col("event_type").alias("key"), F.col("x.event_id").alias("value"))


@query("tier_migration", "SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'cold' ELSE 'hot' END AS desired, CASE WHEN doc_id % 3 = 0 THEN 'cold' ELSE 'hot' END AS actual FROM labels WHERE desired <> actual")
def tier_migration(spark, sf):
    """Documents whose tier isn't the desired one."""
    d = table(spark, sf, "labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "cold").otherwise("hot").alias("desired"), F.when(F.col("doc_id") % 3 == 0, "cold").otherwise("hot").alias("actual"))
    return d.where("desired <> actual")


@query("telemetry_counts", "SELECT event_type AS name, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def telemetry_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("event_windows_tumbling", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows_tumbling(spark, sf):
    w = E.windowed(table(spark, sf, "events"), "1 hour")
    return w.select(F.unix_seconds("starts").alias("starts"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_windows_sliding", "SELECT CAST(epoch(time_bucket(INTERVAL 30 MINUTE, ts)) AS BIGINT) - 1800 * k AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2")
def event_windows_sliding(spark, sf):
    w = E.windowed(table(spark, sf, "events"), "1 hour", "30 minutes")
    return w.select(F.unix_seconds("starts").alias("starts"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "event_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS starts, count(*) AS n FROM s GROUP BY user_id, s""",
)
def event_sessions(spark, sf):
    return E.sessions(table(spark, sf, "events"), "30 minutes").select("user_id", F.unix_micros("starts").alias("starts"), "n")
