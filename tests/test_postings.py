"""The stored index of terms against BM25 over all documents, through changes, and its pruning."""

import random

import pytest

from tessera.operators import postings, search
from tessera.operators.postings import Postings

DOCS = "doc_id long, text string"


def hits(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 7)) for r in df.select("query_id", "doc_id", "score", "rank").collect())


def corpus(n, seed, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    return [(first + i, None if i % 41 == 3 else " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)


def test_equals_bm25_through_changes(spark, tmp_path, small):
    q = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(corpus(30, 9))] + [(99, "nothing here 石膏")], "query_id long, text string")
    index, rows = Postings(spark, f"{tmp_path}/i"), {}
    assert index.search(q, 5).count() == 0 and index.statistics() == (0, 0)

    def same(k=7):
        docs = spark.createDataFrame(list(rows.items()), DOCS)
        assert hits(index.search(q, k)) == hits(search.bm25(docs, q, k))

    rows |= dict(corpus(200, 1))
    index.put(spark.createDataFrame(list(rows.items()), DOCS).repartition(5))
    same()
    changed = dict(corpus(60, 2, 150)) | {500: "石膏板 w1 w2", 501: "w1 " * 300}
    rows |= changed
    index.put(spark.createDataFrame(list(changed.items()), DOCS))
    same()
    gone = [(i,) for i in range(0, 120, 3)] + [(7777,)]
    index.remove(spark.createDataFrame(gone, "doc_id long"))
    rows = {k: v for k, v in rows.items() if (k,) not in gone}
    same()
    same(1)
    among = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")
    every = search.bm25(spark.createDataFrame(list(rows.items()), DOCS), q, 1000).where("doc_id % 2 = 0 and doc_id < 300")
    want = {(r.query_id, r.doc_id) for r in search._ranked(every.drop("rank").withColumnRenamed("doc_id", "item_id"), 6).withColumnRenamed("item_id", "doc_id").collect()}
    assert {(r.query_id, r.doc_id) for r in index.search(q, 6, among).collect()} == want
    before = index.statistics()
    index.compact()
    assert index.statistics() == before and len(index.log._manifest()[1]["files"]) == 1
    same()


def test_names_as_ids_ties_and_many_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "NAMED_TERMS", 3)
    docs = spark.createDataFrame([(f"d{i}", "same words here") for i in range(25)] + [("e", "other words"), ("f", None)], "doc_id string, text string").repartition(4)
    q = spark.createDataFrame([("a", "same words and other ones here")], "query_id string, text string")
    index = Postings(spark, f"{tmp_path}/i")
    index.put(docs)
    assert hits(index.search(q, 9)) == hits(search.bm25(docs, q, 9))


def test_low_blocks_are_skipped():
    import numpy as np

    rows = [("s", "a", b, int(8 - 7 * (b > 0)), 10, np.arange(4 * b, 4 * b + 4, dtype=np.int32), np.full(4, 8 - 7 * (b > 0), np.int32), np.full(4, 10, np.int32)) for b in range(50)]
    heap = postings._Heap(2)
    postings._search_segment(rows, [[("a", 1.0)]], [heap], 10.0, 1.2, 0.75)
    assert [h[2] for h in heap.hits] == [0, 1]
    best = heap.floor
    low = [("t", *r[1:]) for r in rows[1:]]
    postings._search_segment(low, [[("a", 1.0)]], [heap], 10.0, 1.2, 0.75)
    assert heap.floor == best and {h[1] for h in heap.hits} == {"s"}


def test_two_writers_at_once(spark, tmp_path):
    from tessera.sources.store import Conflict

    index, other = Postings(spark, f"{tmp_path}/i"), Postings(spark, f"{tmp_path}/i")
    index.put(spark.createDataFrame([(1, "a b")], DOCS))
    write = other._write

    def late(rows):
        found = write(rows)
        if not late.done:
            late.done = True
            index.put(spark.createDataFrame([(2, "a c")], DOCS))
        return found

    late.done = False
    other._write = late
    with pytest.raises(Conflict):
        other.put(spark.createDataFrame([(3, "a d")], DOCS))
    assert index.statistics() == (2, 4)


def test_segments_close_within_a_batch_and_are_sent_in_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(postings, "SEGMENT_TOKENS", 100)
    monkeypatch.setattr(postings, "SENT", 16, raising=False)
    tokens = [[f"w{(i * j) % 37}" for j in range(10)] if i % 9 else None for i in range(60)]
    ids = list(range(60, 0, -1))
    made = list(postings._segments([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tokens, pa.list_(pa.string()))], names=["doc_id", "tokens"])]))
    heads = {r["segment"]: r for b in made for r in b.to_pylist() if r["term"] == ""}
    assert all(r["max_tf"] < 110 for r in heads.values()) and max(b.num_rows for b in made) <= 16
    found = {(heads[r["segment"]]["ids"][d], r["term"], n) for b in made for r in b.to_pylist() if r["term"] for d, n in zip(r["docs"], r["tf"])}
    assert found == {(i, t, own.count(t)) for i, own in zip(ids, tokens) if own for t in own}
    assert sorted(i for r in heads.values() for i in r["ids"]) == sorted(ids) and sum(r["max_tf"] for r in heads.values()) == sum(len(t or ()) for t in tokens)
