import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import queue as Q
from tessera.sources.store import Store

T0 = datetime.datetime(2026, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_queue(spark, tmp_path):
    q = Q.Queue(spark, f"{tmp_path}/q")
    assert q.claim("w", T0) == []
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, source_id long, operation string, priority string, anchor string")
    q.enqueue(rows((1, 1, "index", "normal", "a1"), (2, 1, "index", "urgent", "a2"), (3, 1, "delete", "odd", None)), T0)
    assert [s["doc_id"] for s in q.claim("w", at(1), 2)] == [2, 1]
    assert [s["doc_id"] for s in q.claim("w2", at(2), 5)] == [3] and q.claim("w3", at(3)) == []
    assert q.fail([1], "boom", at(4)) == 1 and q.complete([3], at(4)) == 1
    assert q.claim("w", at(6)) == [] and [s["doc_id"] for s in q.claim("w", at(9))] == [1]  # five seconds an attempt
    assert [s["doc_id"] for s in q.claim("w", at(70), 5)] == [2, 1]  # their leases ran out
    q.enqueue(rows((2, 9, "index", "low", "a3")), at(80))
    r = q.states().where("doc_id = 2").first()
    assert (r.source_id, r.priority, r.attempts, r.status, r.anchor) == (1, "urgent", 2, "pending", "a3")
    q.fail([1], "no", at(81), retryable=False)
    assert {r.doc_id: r.status for r in q.states().collect()} == {1: "failed", 2: "pending", 3: "completed"}


def test_processing(spark, tmp_path):
    q = Q.Queue(spark, f"{tmp_path}/q")
    q.enqueue(spark.createDataFrame([(k, 1, "index", "normal", f"a{k}") for k in range(4)], "doc_id long, source_id long, operation string, priority string, anchor string"), T0)
    anchors = spark.createDataFrame([(0, "a0"), (1, "a1"), (2, "newer"), (3, "a3")], "doc_id long, anchor string")

    def handle(state):
        if state["doc_id"] == 1:
            raise ValueError("bad")

    assert q.process("w", handle, anchors, at(1), 4) == {0: "completed", 1: "failed", 2: "stale", 3: "completed"}
    assert {r.doc_id: (r.status, r.error_message) for r in q.states().collect()} == {0: ("completed", None), 1: ("pending", "bad"), 2: ("processing", None), 3: ("completed", None)}


def test_cache(spark, tmp_path):
    c = Q.Cache(spark, f"{tmp_path}/c")
    assert c.get("n", "k", T0) is None and c.purge(T0) == 0
    rows = lambda *x: spark.createDataFrame(list(x), "namespace string, key string, value string")
    c.put(rows(("n", "k", "1"), ("n", "l", "2")), T0, 10)
    c.put(rows(("m", "k", "3"), ("n", "l", "4")), T0)
    assert (c.get("n", "k", at(9)), c.get("n", "k", at(10)), c.get("n", "l", at(99)), c.get("m", "k", at(99))) == ("1", None, "4", "3")
    assert c.live(at(99)).count() == 2 and c.live(at(1), "n").count() == 2 and c.purge(at(99)) == 1 and c.store.read().count() == 2


def test_documents(spark, tmp_path, monkeypatch):
    docs = Store(spark, f"{tmp_path}/d", ["doc_id"], "tier")
    docs.upsert(spark.createDataFrame([(1, 7, True, True, "published", "hot"), (2, 7, False, True, "published", "cold"), (3, None, True, True, "Retired", "hot")], "doc_id long, version_group_id long, is_active boolean, index_ready boolean, status string, tier string"))
    vectors, queue = Store(spark, f"{tmp_path}/v", ["item_id"], "doc_id"), Q.Queue(spark, f"{tmp_path}/q")
    vec = lambda *x: spark.createDataFrame(list(x), "item_id string, doc_id long")
    vectors.upsert(vec(("a", 1), ("b", 1), ("c", 2)))
    assert Q.activate_version(docs, 2) == 2 and {r.doc_id: r.is_active for r in docs.read().collect()} == {1: False, 2: True, 3: True}
    assert Q.migrate_tiers(docs) == 3 and {r.doc_id: r.tier for r in docs.read().collect()} == {1: "cold", 2: "hot", 3: "cold"}
    Q.sync_document(docs, vectors, vec(("z", 1), ("y", 2)), 1)
    assert sorted((r.item_id, r.doc_id) for r in vectors.read().collect()) == [("c", 2), ("z", 1)]
    assert Q.deactivate(docs, vectors, queue, 1, T0) == "deleted" and vectors.read().count() == 1 and Q.deactivate(docs, vectors, queue, 99, T0) == "missing"
    monkeypatch.setattr(vectors, "delete", lambda keys: (_ for _ in ()).throw(OSError("away")))
    assert Q.deactivate(docs, vectors, queue, 2, T0) == "queued"
    assert [(s["doc_id"], s["operation"]) for s in queue.claim("w", at(1))] == [(2, "delete_document")]
    monkeypatch.undo()
    with pytest.raises(OSError):
        monkeypatch.setattr(vectors, "replace_documents", lambda rows: (_ for _ in ()).throw(OSError("away")))
        Q.sync_document(docs, vectors, vec(("q", 3)), 3)
    assert docs.read().where("doc_id = 3").first().index_ready is False  # hidden until its rows are there
    assert docs.read().where(F.col("doc_id") == 1).first().is_active is False
