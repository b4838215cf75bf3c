"""Coded and graph indexes of vectors against a full scan; bitmaps against plain conditions."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import bitmaps, search, vectors


def key(df):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.score, 9)) for r in df.collect())


def grouped(n, width=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, width))
    return [(i, (centres[i % 20] + 0.4 * rng.standard_normal(width)).tolist()) for i in range(n)]


def test_codes_with_all_lists_are_exact(spark, tmp_path):
    rows = grouped(600) + [(1000, None), (1001, [0.0] * 12), (1002, [1.0, 2.0]), (1003, grouped(1)[0][1]), (1004, [float("nan")] * 12)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(5)
    q = items.where("item_id % 20 = 0 or item_id >= 1000").withColumnRenamed("item_id", "query_id")
    index = vectors.CodedIndex(spark, f"{tmp_path}/v").build(items, 8)
    assert index.items().count() == len(rows)
    assert key(index.search(q, 10)) == key(search.knn(items, q, 10))
    assert key(vectors.CodedIndex(spark, f"{tmp_path}/v").search(q, 3, block=16)) == key(search.knn(items, q, 3))
    few = index.search(q.where("query_id < 1000"), 10, 2)
    assert search.recall(few, search.knn(items, q.where("query_id < 1000"), 10)) >= 0.9
    assert index.search(q.limit(0), 10).count() == 0


def test_only_codes_are_scanned(spark, tmp_path):
    index = vectors.CodedIndex(spark, f"{tmp_path}/v").build(spark.createDataFrame(grouped(50), "item_id long, vector array<double>"), 4)
    plan = index.items().where(F.col("list_id").isin(1)).select("list_id", "item_id", "code", "error")._jdf.queryExecution().toString()
    assert "code:binary" in plan.split("ReadSchema")[1] and "vector" not in plan.split("ReadSchema")[1] and "PartitionFilters: [" in plan


def test_graph_holds_every_item_and_finds_what_is_near(spark):
    items = spark.createDataFrame([(f"i{i}", v) for i, v in grouped(800)], "item_id string, vector array<double>").repartition(4)
    edges = vectors.neighbour_graph(items, degree=10, rounds=2).cache()
    assert edges.select("src").distinct().count() == 800 and edges.where("src = dst").count() == 0
    assert edges.where("near").groupBy("src").count().agg(F.max("count")).first()[0] <= 10 and edges.dropDuplicates(["src", "dst"]).count() == edges.count()
    q = items.where("item_id like '%0' or item_id like '%7'").withColumnRenamed("item_id", "query_id")
    assert search.recall(vectors.graph_search(edges, items, q, 10, beam=40, entries=8, rounds=12), search.knn(items, q, 10)) >= 0.9
    assert search.recall(vectors.graph_search(edges, items, q, 10, beam=40), search.knn(items, q, 10)) >= 0.9


def test_bitmaps_are_the_plain_conditions(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i * 3, rng.choice(["a", "b", "c", None]), rng.random() < 0.3, rng.randrange(40)) for i in range(70_000)]
    placed = bitmaps.positions(spark.createDataFrame(rows, "id long, kind string, active boolean, scope int"), "id").cache()
    index = bitmaps.bitmap_index(placed, ["kind", "active", "scope"]).cache()
    white = spark.range(0, 210_000, 7)
    met = bitmaps.all_of(bitmaps.any_of(bitmaps.among(index, "kind", ["a", None]), bitmaps.listed(placed, white, "id")), bitmaps.among(index, "active", [True]), bitmaps.none_of(index, bitmaps.among(index, "scope", range(5))))
    want = {r[0] for r in rows if (r[1] in ("a", None) or r[0] % 7 == 0) and r[2] and r[3] >= 5}
    assert {r.id for r in bitmaps.chosen(placed, met).collect()} == want and bitmaps.how_many(met) == len(want)
    monkeypatch.setattr(bitmaps, "BROADCAST_BUCKETS", 0)
    assert bitmaps.chosen(placed, met).count() == len(want)
    none = bitmaps.among(index, "kind", ["nothing"])
    assert bitmaps.chosen(placed, bitmaps.all_of(none, met)).count() == bitmaps.how_many(none) == 0
    assert bitmaps.how_many(bitmaps.none_of(index, none)) == 70_000


def test_walks_keep_a_beam_and_rounds_send_what_may_enter(spark, monkeypatch):
    items = spark.createDataFrame([(f"i{i}", v) for i, v in grouped(600)], "item_id string, vector array<double>").repartition(4)
    kept, stored = [], vectors._stored
    monkeypatch.setattr(vectors, "_stored", lambda df, tag: kept.append((tag, out := stored(df, tag))) or out)
    sent, distinct = [], vectors._nearest
    monkeypatch.setattr(vectors, "_nearest", lambda edges, degree, by="src": (sent.append(edges) if by == "src" else None) or distinct(edges, degree, by))
    edges = vectors.neighbour_graph(items, degree=6, rounds=3)
    best = {s: v for s, v in edges.where("near").groupBy("src").agg(F.min("score")).collect()}
    last = sent[-1].collect()
    assert len(last) < 600 * 2 * 6 and {(r.src, r.dst) for r in last if r.score > best[r.src]} <= {(r.src, r.dst) for r in edges.collect()}
    q = items.where("item_id like '%0'").withColumnRenamed("item_id", "query_id")
    found = vectors.graph_search(edges, items, q, 20, beam=15, width=4, rounds=6)
    walks = [df for tag, df in kept if tag == "walk"]
    assert len(walks) > 3 and all(w.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 20 for w in walks)
    assert found.groupBy("query_id").count().agg(F.min("count")).first()[0] == 20 and found.dropDuplicates(["query_id", "item_id"]).count() == found.count()


def test_an_inverted_file_is_assigned_once(spark):
    from tessera import queries_search

    plan = queries_search.ivf_exact(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "list_id" in plan


def test_best_with_high_floors_is_the_plain_best():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    score = rng.integers(0, 40, (7, 900)) / 40
    best = search._Best(7, 5)
    for lo in range(0, 900, 60):
        best.add(score[:, lo : lo + 60], pa.array(np.arange(lo, lo + 60)))
    out = best.batch(pa.array(np.arange(7))).to_pylist()
    want = [(q, i, score[q, i]) for q in range(7) for i in sorted(range(900), key=lambda i: (-score[q, i], str(i)))[:5]]
    assert [(r["query_id"], r["item_id"], r["score"]) for r in out] == want
