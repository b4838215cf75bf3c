from tessera.sources.store import Store


def rows(store):
    return sorted((r.k, r.v, r.p) for r in store.read().collect())


def test_upsert_delete_and_replace(spark, tmp_path):
    df = lambda *x: spark.createDataFrame(list(x), "k int, doc_id int, v int, p string")
    s = Store(spark, f"{tmp_path}/t", ["k"], "p")
    assert s.read() is None and s.delete(df((1, 1, 1, "a")).select("k")) == 0
    s.upsert(df((1, 1, 1, "a"), (2, 1, 2, "a"), (3, 2, 3, "b"), (3, 2, 9, "b")), order="v")
    assert rows(s) == [(1, 1, "a"), (2, 2, "a"), (3, 9, "b")]
    s.upsert(df((2, 1, 20, "a"), (4, 3, 4, "c")))
    assert rows(s) == [(1, 1, "a"), (2, 20, "a"), (3, 9, "b"), (4, 4, "c")]
    assert s.delete(df((3, 0, 0, "")).select("k")) == 1 and rows(s) == [(1, 1, "a"), (2, 20, "a"), (4, 4, "c")]
    s.replace_documents(df((7, 1, 7, "a")))
    assert rows(s) == [(4, 4, "c"), (7, 7, "a")]


def test_a_stream_is_followed(spark, tmp_path):
    spark.createDataFrame([(i, i % 4, i, "ab"[i % 2]) for i in range(20)], "n int, k int, v int, p string").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("n int, k int, v int, p string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    s = Store(spark, f"{tmp_path}/t", ["k"], "p")
    q = s.follow(stream, f"{tmp_path}/c", "n")
    q.awaitTermination(120)
    assert sorted(r.k for r in s.read().collect()) == [0, 1, 2, 3]


def table(spark, path, **more):
    s = Store(spark, path, ["k"], "p", **more)
    return s, lambda *x: spark.createDataFrame(list(x), "k int, doc_id int, v int, p string")


def test_odd_partition_values_and_null_keys(spark, tmp_path):
    s, df = table(spark, f"{tmp_path}/t")
    odd = [None, "a/b", "x=y", "", " ", "é漢", "%2F", "__HIVE_DEFAULT_PARTITION__"]
    s.upsert(df((1, 1, 1, None), (2, 1, 2, "a")))
    s.upsert(df((3, 1, 3, None)))
    assert sorted(r.k for r in s.read().collect()) == [1, 2, 3]
    s.upsert(df(*((10 + i, 7, i, p) for i, p in enumerate(odd)), (None, 8, 0, "a/b")))
    s.upsert(df((None, 8, 5, "a/b")))
    got = {r.k: (r.v, r.p) for r in s.read().collect()}
    assert got == {1: (1, None), 2: (2, "a"), 3: (3, None), None: (5, "a/b")} | {10 + i: (i, p) for i, p in enumerate(odd)}
    assert s.delete(df((11, 0, 0, "")).select("k")) == 1 and s.delete(df((0, 0, 0, None)).select("p")) == 3
    assert sorted(r.k or 0 for r in s.read().collect()) == [0, 2, 12, 13, 14, 15, 16, 17]
    assert s.delete(df((None, 0, 0, "")).select("k")) == 1 and s.delete(df((99, 0, 0, "")).select("k")) == 0


def test_moved_keys_ties_and_updates(spark, tmp_path):
    s, df = table(spark, f"{tmp_path}/t")
    s.upsert(df((1, 1, 1, "a"), (2, 1, 2, "a"), (3, 2, 3, "b")))
    s.upsert(df((1, 1, 9, "b")))
    assert rows(s) == [(1, 9, "b"), (2, 2, "a"), (3, 3, "b")]
    for _ in range(2):  # of several rows with a key the same one counts every time
        s.upsert(df((4, 1, 5, "c"), (4, 1, 7, "c"), (4, 1, 6, "c")).repartition(3))
        assert (4, 7, "c") in rows(s)
    from pyspark.sql import functions as F

    assert s.update(F.col("doc_id") == 1, {"v": F.col("v") * 10, "p": F.lit("b")}) == 3
    assert rows(s) == [(1, 90, "b"), (2, 20, "b"), (3, 3, "b"), (4, 70, "b")] and s.update(F.col("k") > 99, {"v": F.lit(0)}) == 0
    s.upsert(spark.createDataFrame([(5, 3, "new", "z")], "k int, doc_id int, note string, p string"))
    assert {r.k: (r.v, r.note) for r in s.read().collect()}[5] == (None, "new") and s.read().count() == 5


def test_versions_failures_and_transactions(spark, tmp_path, monkeypatch):
    import pytest

    from tessera.sources.store import Conflict, transaction

    s, df = table(spark, f"{tmp_path}/t")
    s.upsert(df((1, 1, 1, "a"), (2, 1, 2, "b")))
    before, reader = rows(s), s.read()
    monkeypatch.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("halfway")))
    with pytest.raises(OSError):
        s.upsert(df((1, 1, 100, "a")))
    monkeypatch.undo()
    assert rows(s) == before
    s.delete(df((1, 0, 0, "")).select("k"))
    assert sorted(r.k for r in reader.collect()) == [1, 2]  # a reader keeps the version that it began with
    assert sorted(r.k for r in s.read(1).collect()) == [1, 2] and s.versions() == [1, 2]
    with pytest.raises(Conflict):
        s._commit(0, None, {})
    other, _ = table(spark, f"{tmp_path}/u")
    with pytest.raises(ZeroDivisionError):
        with transaction(s, other):
            s.upsert(df((7, 7, 7, "q")))
            with transaction(other):
                other.upsert(df((8, 8, 8, "q")))
            1 / 0
    assert rows(s) == [(2, 2, "b")] and other.read() is None
    with transaction(s):
        s.upsert(df((7, 7, 7, "q")))
    assert rows(s) == [(2, 2, "b"), (7, 7, "q")] and s.vacuum(1) >= 1 and rows(s) == [(2, 2, "b"), (7, 7, "q")]
