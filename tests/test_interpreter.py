"""Plans of a batch of queries against the same plans run one by one in plain loops."""

import random

from pyspark.sql import functions as F

from tessera.plans import interpreter as I
from tessera.plans import paths

STEP = "array<struct<branch:string,limit:int,variant:string>>"


def world(spark, calls):
    """Retrievers over a table of made-up hits, and the hits themselves."""
    rng = random.Random(3)
    data = {(b, q): [(f"i{rng.randrange(30)}{b[0]}{n}", round(1 - n / 20, 3)) for n in range(rng.choice([0, 1, 3, 12]))] for b in ("vector", "section", "special", "vector:section_summary", "vector:doc_summary") for q in range(12)}
    table = spark.createDataFrame([(b, q, i, s, n) for (b, q), hits in data.items() for n, (i, s) in enumerate(hits, 1)], "b string, query_id long, item_id string, score double, rank int")

    def retriever(name):
        def run(queries, most):
            calls.append((name, sorted((r.query_id, r.text) for r in queries.collect()), most))
            return table.where((F.col("b") == name) & (F.col("rank") <= most)).join(queries.select("query_id"), "query_id").select("query_id", "item_id", "score", "rank")

        return run

    return data, {b: retriever(b) for b in ("vector", "section", "special", "vector:section_summary", "vector:doc_summary")}


def test_paths_and_fallback_are_those_of_single_queries(spark):
    calls = []
    data, retrievers = world(spark, calls)
    rng, rows = random.Random(5), []
    for q in range(12):
        steps = [(b, rng.choice([1, 4, 9]), "sparse" if b == "section" else "dense") for b in rng.sample(["vector", "section", "global", "special"], rng.randrange(0, 4))]
        rows.append((q, f"t{q}", f"s{q}" if q % 2 else None, steps + steps[:1], [("few", "special", 3)] if q % 3 else []))
    queries = spark.createDataFrame(rows, f"query_id long, text string, sparse_text string, paths {STEP}, fallback array<struct<trigger:string,branch:string,limit:int>>")
    got = sorted((r.query_id, r.step, r.branch, r.item_id, r["rank"]) for r in I.run_plans(queries, retrievers, I.too_few(3, "few")).collect())
    want = []
    for q, _, _, steps, fallback in rows:
        limits = {}
        for b, n, _ in steps:
            limits[b] = max(n, limits.get(b, 0))
        own = [(q, "main", b, i, k) for b, n in limits.items() for k, (i, _) in enumerate(data.get((b, q), ())[:n], 1)]
        if len({x[3] for x in own}) < 3:
            own += [(q, "fallback", b, i, k) for _, b, n in fallback if b not in limits for k, (i, _) in enumerate(data[b, q][:n], 1)]
        want += own
    assert got == sorted(want) and any(w[1] == "fallback" for w in want)
    assert all(t == (f"s{q}" if name == "section" and q % 2 else f"t{q}") for name, asked, _ in calls for q, t in asked)
    assert [c[0] for c in calls].count("vector") == 1 and all(len(c[1]) < 12 for c in calls)
    assert {(r.query_id, r.branch) for r in I.unavailable(queries, retrievers).collect()} == {(q, "global") for q, _, _, s, _ in rows if "global" in [x[0] for x in s]}
    assert I.run_plans(queries.limit(0), retrievers).count() == 0


def test_stages_run_for_queries_that_need_them(spark):
    calls = []
    data, retrievers = world(spark, calls)
    plain = spark.createDataFrame([(q, f"t{q}", q % 4 == 0) for q in range(12)], "query_id long, text string, special boolean")
    queries = plain.withColumn("stages", paths.stage_plans(F.lit(4), F.lit(3), F.col("special"), F.lit("text")))
    got = sorted((r.query_id, r.branch, r.item_id, r["rank"], r.stage) for r in I.run_stages(queries, retrievers).collect())
    want = []
    for q in range(12):
        first = [i for i, _ in data["vector:section_summary", q][:8]]
        own = [(q, "vector", i, k, 0) for k, i in enumerate(first, 1)]
        if len(first) < 3:
            more = [i for i, _ in data["vector:doc_summary", q][:4] if i not in first]
            own += [(q, "vector", i, len(first) + k, 1) for k, i in enumerate(more, 1)]
        want += own
    assert got == sorted(want)
    assert [len(asked) for name, asked, _ in calls if name == "vector:doc_summary"] == [sum(len(data["vector:section_summary", q]) < 3 for q in range(12))]
