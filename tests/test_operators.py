import numpy as np
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import spans
from tessera.functions import text as T
from tessera.operators import context, evaluation, rank, search, tables
from tessera.plans import planner
from tessera.plans.expressions import ExpressionError, parse
from tessera.sources import files, web
from tessera.streaming import events as E
from tessera.streaming import guards


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_terms_of_mixed_scripts(spark):
    text = "石膏板 Sales 2026年销量 abc ABC 年"
    assert one(spark, T.search_terms("t"), t=text) == ["sales", "2026", "abc", "石膏板", "石膏", "膏板", "年销量", "年销", "销量", "年"]
    assert one(spark, T.text_unit_count("t"), t=text) == 4 + 7
    assert one(spark, T.search_terms("t"), t=None) == [] and one(spark, T.text_unit_count("t"), t="") == 0
    assert one(spark, T.sentences("t"), t="一。二！ three? four;\nfive") == ["一。", "二！", "three?", "four;", "five"]


def test_phones_and_anchors(spark):
    assert one(spark, T.mask_phones("t"), t="call 13812345678 now") == "call [手机号脱敏] now"
    assert one(spark, T.mask_phones("t"), t="电话13812345678") == "电话13812345678"
    anchor = one(spark, T.asset_anchor("t"), t="table 1/é:~x")
    assert anchor == "[ASSET_ANCHOR:table%201%2F%C3%A9:~x]"
    assert one(spark, T.asset_references("t"), t=f"aa{anchor}bb") == ["table 1/é:~x"]


def test_code_and_command_heuristics(spark):
    code = "def f(x):\n    return x\n\nclass A:\n    pass"
    assert one(spark, T.looks_code_like("t"), t=code) and not one(spark, T.looks_code_like("t"), t="plain words\nand more of them")
    assert one(spark, T.looks_command_like("t"), t="run it with --verbose") and not one(spark, T.looks_command_like("t"), t="a well-known thing")


def test_windows_stop_at_the_end(spark):
    assert [a for a, _ in spans.window_bounds(70, 24, 4)] == [0, 20, 40, 60]
    assert spans.window_bounds(24, 24, 4) == [(0, 24)] and spans.window_bounds(0, 24, 4) == []
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("ab1 é石。\n") for _ in range(rng.randrange(60)))
        start, end = spans.token_spans(text)
        assert [text[a:b] for a, b in zip(start, end)] == re.findall(r"[A-Za-z0-9]+|[㐀-䶿一-鿿]", text)
    docs = spark.createDataFrame([(1, " ".join(map(str, range(70)))), (2, None), (3, "")], "doc_id long, text string")
    rows = spans.windows(docs, "doc_id", "text", 24, 4).collect()
    assert [r.token_start for r in rows] == [0, 20, 40, 60] and rows[3].window_text.split() == [str(k) for k in range(60, 70)]
    assert spans.sample("a " * 5001).count("\n...\n") == 2 and spans.clip("a b c", 2) == "a b"


def test_ranking_golden(spark):
    predicted = spark.createDataFrame([(1, "x", 1), (1, "b", 2), (1, "a", 3)], "query_id int, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "c", 1), (3, "d", 0)], "query_id int, doc_id string, relevance int")
    got = {r.query_id: tuple(r)[1:] for r in evaluation.ranking_metrics(predicted, gold).collect()}
    assert got[1][:3] == (1, 1.0, 0.5) and got[1][3] == pytest.approx(0.54134, abs=1e-5)
    assert got[2] == (0, 0.0, 0.0, 0.0) and 3 not in got


def test_knn_blocks_and_zero_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(200, [0.0] * 8), (201, None)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(3)
    queries = items.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)), 12) if a and b and norm(a) and norm(b) else 0.0
    table = dict(rows)
    for block in (4096, 3):
        got = {(r.query_id, r["rank"]): r.item_id for r in search.knn(items, queries, 5, block).collect()}
        for q in range(0, 201, 20):
            want = sorted(table, key=lambda i: (-cosine(table[q], table[i]), str(i)))[:5]
            assert [got[q, k] for k in range(1, 6)] == want


def test_expressions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, s string")
    keep = lambda e: sorted(r.k for r in df.where(parse(e, ["k", "s"])).collect())
    assert keep('k in [1, 3] and (s == "a" or k >= 3)') == [1, 3] and keep("") == [1, 2, 3] and keep("k in []") == []
    for bad in ("z == 1", "k ==", "k in [1", "k = 1", "(k == 1", "k == s", "k == 1; drop"):
        with pytest.raises(ExpressionError):
            parse(bad, ["k", "s"])


def test_comparison_split(spark):
    assert one(spark, planner.comparison_sides(F.col("t")), t="Compare Alpha and Beta across finance documents") == ["Alpha", "Beta across finance documents"]
    assert one(spark, planner.comparison_sides(F.col("t")), t="苹果 和 梨。") == ["苹果", "梨"] and one(spark, planner.comparison_sides(F.col("t")), t="only one") is None


def test_header_detection():
    data = [["Alice", 30, 95.5], ["Bob", 25, 80], ["Eve", 41, 77.25], ["Dan", 29, 60], ["Kim", 33, 71]]
    assert tables.header_rows([["Name", "Age", "Score"], *data]) == [0]
    assert tables.header_columns([["Report 2026", "", ""], ["Name", "Age", "Age"], *data]) == ["Name", "Age", "Age_2"]
    assert tables.header_rows([["1", "2"], ["3", "4"]]) == [] and tables.header_rows([]) == []


def test_web_page_sections():
    html = "<html><head><title> A  B </title><style>p{}</style></head><body><p>nav</p><article><p>intro</p><h1>One</h1><p>x <b>y</b></p><p>z</p><h2>Two</h2><p>w</p><h1>Three</h1><p>v</p></article></body></html>"
    title, found = web.parse_page(html, "http://h/x.html")
    assert title == "A B" and [(s["toc_path"], s["section_text"]) for s in found] == [(["A B"], "intro"), (["One"], "x y z"), (["One", "Two"], "w"), (["Three"], "v")]
    visible = " ".join(s["section_text"] for s in found)
    assert all(visible[s["char_start"] : s["char_end"]] == s["section_text"] for s in found)
    assert web.parse_page("", "http://h/name.html") == ("name", [{"order_index": 0, "toc_path": ["name"], "level": 1, "section_text": "name", "char_start": 0, "char_end": 4}])


def test_markdown_and_routes(spark):
    docs = spark.createDataFrame([(1, "lead\n# A\nx\n### C\ny\n## B\n\n# D\nz"), (2, None)], "k int, t string")
    got = [(r.toc_path, r.section_text) for r in files.markdown_sections(docs, "k", "t").orderBy("k", "order_index").collect()]
    assert got == [([], "lead"), (["A"], "x"), (["A", "C"], "y"), (["D"], "z")]
    for location, kind in (("a/b.PDF", "pdf"), ("http://x/y.md?z=1.txt", "markdown"), ("noext", None), ("x.exe", None)):
        assert one(spark, files.source_type(F.col("t")), t=location) == kind


def test_limiter_and_breaker():
    limiter = guards.Limiter(60, 2)
    assert [limiter.allow(t) for t in (0, 1, 2, 59, 60, 60.5, 61.5)] == [True, True, False, False, False, True, True]
    b = guards.Breaker(failures=2, cooldown=10, probes=1, successes=2)
    assert b.call(0, False) and b.call(1, False) and b.state == "open"
    assert not b.call(5, True) and b.call(12, True) and b.state == "half_open"
    assert not b.call(13, True) and b.call(23, True) and b.state == "closed"


def test_keyed_folds_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), i, rng.uniform(0, 500)) for i in range(400)]
    got = {r.event_id: r.allowed for r in guards.limit_rate(spark.createDataFrame(rows, "user_id long, event_id long, at double").repartition(5), 60, 5).collect()}
    limiters: dict = {}
    want = {i: limiters.setdefault(u, guards.Limiter(60, 5)).allow(t) for u, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1]))}
    assert got == want


def test_budgets(spark):
    ev = spark.createDataFrame([(1, 1, 3000, 9.0), (1, 2, 30, 8.0), (1, 3, 500, 7.0), (2, 4, 10, 1.0)], "query_id int, evidence_id int, tokens int, score double")
    got = {r.evidence_id: r.assigned for r in context.token_budgets(ev, 2800, [F.desc("score")]).collect()}
    assert got == {1: 2500, 2: 0, 3: 300, 4: 10}


def test_versions_and_exit(spark):
    c = spark.createDataFrame([(1, "a", 1, 1, 0.5), (1, "a", 1, 2, 0.4), (1, "b", None, None, 0.3)], "query_id int, candidate_id string, version_group_id int, version_no int, score double").withColumn("kind", F.lit("x"))
    assert sorted((r.candidate_id, r.version_no) for r in rank.newest_versions(c).collect()) == [("a", 2), ("b", None)]
    r = spark.createDataFrame([(1, 1, 0.5, None), (2, 1, 0.5, -1.0), (2, 2, 0.1, 1.0), (3, 1, 0.5, 1.0), (3, 2, 0.4, 1.0)], "query_id int, rank int, final_score double, rerank_score double")
    assert {x.query_id: x.decision for x in rank.exit_signal(r, True).collect()} == {1: "answer", 2: "asset_fallback", 3: "answer"}


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [(i, i % 3, ["a", "b"][i % 2], float(i), 1_700_000_000 + i * 600) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    key = lambda r: (r.starts, r.event_type, r.n, r.total)
    q = E.windowed(stream, "1 hour", late="10 days").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(60)
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, E.windowed(df, "1 hour").collect()))
    q = E.to_table(stream, f"{tmp_path}/out", f"{tmp_path}/c2", ["user_id"], "event_id")
    q.awaitTermination(60)
    kept = search.latest(spark.read.parquet(f"{tmp_path}/out"), ["user_id"], ["event_id"]).collect()
    assert sorted((r.user_id, r.event_id) for r in kept) == [(0, 48), (1, 49), (2, 47)]


def test_ragged_vectors_change_no_others(spark):
    rng = np.random.default_rng(3)
    good = {i: [float(x) for x in rng.normal(size=4)] for i in range(40)}
    rows = [*good.items(), (100, [1.0] * 5), (101, None), (102, [0.0] * 4), (103, [float("nan")] * 4), (104, [])]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, good[i]) for i in range(5)] + [(9, [1.0] * 5), (10, None)], "query_id long, vector array<double>")
    got = {}
    for r in search.knn(items, queries, 45).collect():
        got.setdefault(r.query_id, {})[r.item_id] = r.score
    for q in range(5):
        for i, v in good.items():
            want = np.dot(good[q], v) / np.linalg.norm(good[q]) / np.linalg.norm(v)
            assert abs(got[q][i] - want) < 1e-9
        assert all(got[q][i] == 0 for i in (100, 101, 102, 103, 104))
    assert set(got[10].values()) == {0.0} and set(got[9].values()) == {0.0}


def test_inverted_file_index(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=16) * 0.4]) for i in range(1200)] + [(5000, None)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(5)
    queries = items.where("item_id % 20 = 0 AND item_id < 5000").withColumnRenamed("item_id", "query_id")
    c = search.centroids(items, 16, sample=500)
    index = search.ivf_index(items, c)
    assert index.count() == 1201 and len(c) == 16
    exact = search.knn(items, queries, 10)
    key = lambda df: sorted((r.query_id, r["rank"], r.item_id, round(r.score, 9)) for r in df.collect())
    assert key(search.ivf_search(index, c, queries, 10, 16, block=13)) == key(exact)
    assert search.recall(search.ivf_search(index, c, queries, 10, 4), exact) >= 0.9
    assert search.ivf_search(index, c, queries.limit(0), 10, 4).count() == 0


def test_term_search_matches_brute_force(spark):
    import collections
    import math
    import re

    rng = np.random.default_rng(5)
    docs = [(i, " ".join(rng.choice(list("abcdefg"), rng.integers(0, 30)))) for i in range(300)] + [(900, None), (901, "")]
    queries = [(i, " ".join(rng.choice(list("abcxyz"), 3))) for i in range(20)] + [(50, None), (51, "zzz")]
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = collections.Counter(w for x in words.values() for w in set(x))
    want = {}
    for q, t in queries:
        scores = []
        for i, x in words.items():
            tf = collections.Counter(x)
            s = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in set((t or "").split()) if tf[w])
            if s > 0:
                scores.append((-round(s, 9), str(i), i))
        want |= {(q, r): i for r, (_, _, i) in enumerate(sorted(scores)[:7], 1)}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(queries, "query_id long, text string")
    assert {(r.query_id, r["rank"]): r.doc_id for r in search.bm25(d, q, 7).collect()} == want
    assert search.bm25(d, q.limit(0), 7).count() == 0 and search.bm25(d.limit(0), q, 7).count() == 0


def test_global_rate_limit_matches_a_plain_loop(spark):
    from tessera.streaming import guards

    rng = np.random.default_rng(6)
    rows = sorted((float(rng.integers(0, 400)), int(rng.integers(0, 6)), i) for i in range(600))
    want, own, every = {}, {}, []
    for at, user, i in sorted(rows, key=lambda r: (r[0], r[2])):
        every = [t for t in every if t >= at - 60]
        own[user] = [t for t in own.get(user, []) if t >= at - 60]
        want[i] = len(every) < 40 and len(own[user]) < 9
        if want[i]:
            every.append(at)
            own[user].append(at)
    events = spark.createDataFrame([(u, i, at) for at, u, i in rows], "user_id long, event_id long, at double").repartition(4)
    assert {r.event_id: r.allowed for r in guards.limit_rate(events, 60.0, 9, everybody=40).collect()} == want


def test_retrieval_report_matches_a_plain_loop(spark):
    import collections

    from tessera.operators import evaluation as E

    rng = np.random.default_rng(8)
    sections = [(s, s // 10, 1, ["a", str(s // 5)], None if s % 7 == 0 else s // 5, s % 5) for s in range(60)]
    by = {s[0]: s for s in sections}
    queries = [(q, [None, "fact", "rule"][q % 3]) for q in range(60)]
    gold = [(q, int(s) // 10, int(s)) for q in range(60) for s in rng.choice(70, 2, replace=False)]
    predicted = [(q, r, int(s) // 10, int(s)) for q in range(55) for r, s in enumerate(rng.choice(65, int(rng.integers(1, 13)), replace=False), 1)]
    want = {}
    for q, kind in queries:
        mine, docs, secs = [p for p in predicted if p[0] == q], {d for x, d, _ in gold if x == q}, {s for x, _, s in gold if x == q}
        group = lambda s: (s[1], s[2], tuple(s[3]), s[4])

        def first(ok):
            return min((r for _, r, d, s in mine if r <= 10 and ok(d, s)), default=None)  # noqa: B023

        def related(s, near):
            if s not in by:
                return False
            return any(s == g or (by[s][4] is not None and group(by[s]) == group(by[g]) and (not near or abs(by[s][5] - by[g][5]) <= 1)) for g in secs if g in by)  # noqa: B023

        doc, sec = first(lambda d, s: d in docs), first(lambda d, s: s in secs)
        known = any(g in by for g in secs)
        par, nei = (first(lambda d, s: related(s, False)), first(lambda d, s: related(s, True))) if known else (sec, sec)
        same = any(s in by and by[s][1] in docs for _, _, _, s in mine)
        miss = "doc_miss" if doc is None else "same_parent_neighbor" if nei else "same_parent_non_neighbor" if par else "same_doc_other_section" if same else "section_miss_other"
        want[q] = (kind or "unknown", doc, sec, par, nei, len(mine), None if sec else miss)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    details = E.retrieval_details(
        frame(queries, "query_id int, question_type string"), frame(predicted, "query_id int, rank int, doc_id int, section_id int"), frame(gold, "query_id int, doc_id int, section_id int"),
        frame(sections, "section_id int, doc_id int, source_id int, toc_path array<string>, parent_section_id int, window_index int"), 10,
    )
    assert {r.query_id: tuple(r)[1:] for r in details.collect()} == want
    report = {r.question_type: r for r in E.retrieval_report(details, 10).collect()}
    assert report.keys() == {None, "fact", "rule", "unknown"} and "doc_hit_20" not in report[None].asDict()
    for kind, r in report.items():
        own = [w for w in want.values() if kind in (None, w[0])]
        share = lambda i, k: sum(w[i] is not None and w[i] <= k for w in own) / len(own)  # noqa: B023, E731
        assert r.queries == len(own) and abs(r.section_hit_5 - share(2, 5)) < 1e-5 and abs(r.neighbor_hit_10 - share(4, 10)) < 1e-5
        assert abs(r.doc_mrr - sum(1 / w[1] for w in own if w[1]) / len(own)) < 1e-5 and (r.candidates_min, r.candidates_max) == (min(w[5] for w in own), max(w[5] for w in own))
        assert collections.Counter(w[6] for w in own if w[6]) == {c: n for c in ("doc_miss", "same_parent_neighbor", "same_parent_non_neighbor", "same_doc_other_section", "section_miss_other") if (n := r[c])}
