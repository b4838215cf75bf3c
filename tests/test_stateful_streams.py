"""Streams with state against the batch folds: over several micro-batches, with a restart between them."""

import random

from pyspark.sql import functions as F

from tessera.streaming import guards
from tessera.streaming.stateful import Lease, break_stream, lease_stream, limit_stream


def written(spark, rows, schema, folder, parts=4):
    """Rows in the order of time, as files that follow each other."""
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    size = -(-len(rows) // parts)
    for k in range(parts):
        df = spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1)
        df.withColumn("at", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).write.parquet(f"{folder}/in/{k:02d}")


def streamed(spark, folder, make, rounds):
    """Output of the stream; each round takes in some more of the files and is a new query on the same checkpoint."""
    schema = spark.read.parquet(f"{folder}/in/00").schema
    for upto in rounds:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/{upto}").withWatermark("at", "1 second")
        query = make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
    return spark.read.parquet(f"{folder}/out").collect()


def test_limiter_and_breaker_streams_equal_the_folds(spark, tmp_path):
    rng = random.Random(8)
    events = [(rng.randrange(6), i, round(rng.uniform(0, 900), 3)) for i in range(400)]
    written(spark, events, "user_id long, event_id long, at double", tmp_path / "limit")
    want = {r.event_id: r.allowed for r in guards.limit_rate(spark.createDataFrame(events, "user_id long, event_id long, at double"), 60.0, 3).collect()}
    got = streamed(spark, tmp_path / "limit", lambda s: limit_stream(s, 60.0, 3), ["{00,01}", "{00,01,02,03}"])
    assert len(got) == len(want) and {r.event_id: r.allowed for r in got} == want and not all(want.values())

    calls = [(rng.randrange(3), i, round(rng.uniform(0, 900), 3), rng.random() < 0.5) for i in range(300)]
    written(spark, calls, "circuit long, event_id long, at double, ok boolean", tmp_path / "break")
    config = {"failures": 2, "cooldown": 20.0}
    want = {r.event_id: (r.passed, r.state) for r in guards.break_circuits(spark.createDataFrame(calls, "circuit long, event_id long, at double, ok boolean"), **config).collect()}
    got = streamed(spark, tmp_path / "break", lambda s: break_stream(s, **config), ["{00,01,02}", "{00,01,02,03}"])
    assert {r.event_id: (r.passed, r.state) for r in got} == want and len({w[1] for w in want.values()}) == 3


def test_leases_expire_and_are_taken_again(spark, tmp_path):
    rng = random.Random(4)
    kinds = ["claim", "claim", "renew", "complete", "fail", "enqueue"]
    events = [(rng.randrange(5), i, round(rng.uniform(0, 3000), 3), rng.choice(kinds), rng.choice("ab")) for i in range(200)]
    written(spark, events, "item_id long, event_id long, at double, kind string, worker string", tmp_path)
    want, leases = {}, {}
    for item, i, at, kind, worker in sorted(events, key=lambda r: (r[2], r[1])):
        lease = leases.setdefault(item, Lease(100.0, 3))
        want[i] = (lease.event(at, kind, worker), lease.status, lease.worker)
    got = streamed(spark, tmp_path, lambda s: lease_stream(s, 100.0, 3), ["{00,01}", "{00,01,02,03}"])
    assert {r.event_id: (r.counts, r.status, r.worker) for r in got if r.event_id is not None} == want
    assert any(r.status == "expired" for r in got if r.event_id is None)
