import random

from pyspark.sql import functions as F

from tessera.functions import spans
from tessera.operators import answers as A
from tessera.operators import context


def evidence(spark, rows):
    return spark.createDataFrame(rows, "query_id long, place int, evidence_id string, text string, anchor string, path array<string>, score double, record_type string")


def test_answers(spark):
    e = evidence(spark, [
        (1, 1, "E1", "Alpha sales rose. uv run alpha sales report. Beta fell!", "a", None, 0.5, "section"), (1, 2, "E2", "What are alpha sales? They were 7.", "b", ["x"], 0.9, "table"),
        (2, 1, "E1", "Intro text. The `gamma` rule applies here.", "Gamma", None, 0.1, "section"), (2, 2, "E2", "Gamma gamma.", "none", None, 0.9, "section"), (3, 1, "E1", "  ", "a", None, 0.1, "section"),
        (5, 1, "E1", "uv run me", "a", None, 0.1, "section"),
    ])
    q = spark.createDataFrame([(1, "alpha sales", None, False, []), (2, "gamma", ["gamma"], True, []), (3, "x", None, False, []), (4, "y", None, False, []), (5, "me", None, False, [])], "query_id long, query string, focus array<string>, needs_structure boolean, targets array<string>")
    got = {r.query_id: r.answer for r in A.grounded_candidates(q, e).collect()}
    assert got == {1: "Alpha sales rose.", 2: "The gamma rule applies here", 3: A.NO_EVIDENCE, 4: A.NO_EVIDENCE, 5: "uv run me"}
    wanted = q.withColumn("targets", F.array(F.lit("table")))
    assert {r.query_id: r.answer for r in A.grounded_candidates(wanted, e).collect()}[1] == "What are alpha sales? They were 7."
    short = {r.query_id: r.insufficient for r in A.insufficient(q, e).collect()}
    assert short == {1: False, 2: False, 3: True, 4: True, 5: False}
    a = spark.createDataFrame([(1, "alpha sales"), (2, "nothing shared")], "query_id long, answer string")
    assert sorted((r.query_id, r.evidence_id) for r in A.supporting(a, e).collect()) == [(1, "E1"), (1, "E2"), (2, "E2")]


def one(spark, column, **values):
    return spark.range(1).select(*(v.alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_claims_and_references(spark):
    pack = F.array(F.lit("The **cat** sat on the mat [Doc-1]."), F.lit("Dogs bark loudly"))
    for claim, ok in (("- The cat sat on the mat.", True), ("cat mat dogs bark. The cat sat", True), ("birds fly south. The cat sat on the mat", False), ("", False), ("dogs", False)):
        assert one(spark, A.claims_supported(F.lit(claim), pack)) == ok, claim
    assert one(spark, A.support_score(F.lit("what cat zebra"), F.lit("a cat"))) == 0.5 and one(spark, A.support_score(F.lit("?!"), F.lit("a"))) == 1.0
    refs, names = F.array(F.lit("[1:2]"), F.lit("[1:2]"), F.lit("[3]"), F.lit("[4]")), F.create_map(F.lit("Doc-1"), F.lit("[1:2]"))
    assert one(spark, A.with_references(F.lit(" x [Doc-1] y [Doc-9]  z"), refs, names)) == "x [1:2] y z"
    assert one(spark, A.with_references(F.lit("plain"), refs, names)) == "plain [1:2][3]"
    assert one(spark, A.reference(F.lit(5), F.lit(None).cast("int"), F.lit(8))) == "[5:8]"


def test_citations(spark):
    cites = [{"evidence_id": f"E{k}", "file_name": f"f{k}.md", "section_path": ["a", "b"] if k == 1 else [], "citation_anchor": "anchor", "page_start": k, "page_end": k + (k == 2)} for k in (1, 2, 3)]
    body, notes, whole, n = A.format_answer("x [Doc-2] y [Doc-1] z [Doc-2] w [Doc-7]  end", ["E1", "E2", "E3"], cites)
    assert body == "x ¹ y ² z ¹ w end" and n == 2 and notes == "¹ f2.md — anchor — p.2-3\n² f1.md — a > b — p.1" and whole == body + A.FOOTNOTES + notes
    assert A.format_answer("p [2:3] q [section-1] r [doc-9:8]", ["E1", "E2", "E3"], cites)[0] == "p ¹ q ² r ³"
    assert A.format_answer("same [Doc-1] [Doc-2]", ["E1", "E1"], cites)[0] == "same ¹" and A.format_answer("t [Doc-1]", ["E1"], []) == ("t [Doc-1]", "", "t [Doc-1]", 0)
    assert A.format_answer("no marks", ["E3", "E3"], cites)[1:] == ("¹ f3.md — anchor — p.3", "no marks" + A.FOOTNOTES + "¹ f3.md — anchor — p.3", 1)
    df = spark.createDataFrame([("x [Doc-1]", ["E1"], cites)], "answer string, links array<string>, citations array<struct<evidence_id:string,file_name:string,section_path:array<string>,citation_anchor:string,page_start:int,page_end:int>>")
    r = A.formatted(df).first()
    assert (r.body, r.footnotes, r.n_citations) == ("x ¹", "¹ f1.md — a > b — p.1", 1)


def test_cleaning(spark):
    assert one(spark, A.clean_summary(F.lit("This section DISCUSSES: - the  rules\r\n\r\n next "))) == "the rules\nnext" and one(spark, A.clean_summary(F.lit(None))) == ""
    assert one(spark, A.without_instructions(F.lit("<system_instruction>\nx\n</system_instruction>\n[T] y"))) == "[T] y"
    r = one(spark, A.compute_request(F.lit('ok <compute_request>\n{"asset_id": 4, "sql": "SELECT 1"}\n</compute_request>')))
    assert (r.asset_id, r.sql) == ("4", "SELECT 1") and one(spark, A.compute_request(F.lit('<compute_request>{"sql": "x"}</compute_request>'))) is None
    c = one(spark, A.parsed_contract(F.lit("Semantic Core: c d\nFact Anchors: A, B1\nStructural Hint: none")))
    assert (c.semantic_core, c.fact_anchors, c.structural_hints) == ("c d", ["A", "B1"], []) and one(spark, A.parsed_contract(F.lit("Semantic Core: c"))) is None
    assert spans.clip(" a b c ", 2, ellipsis=True) == "a b ..." and spans.clip("a b", 2, ellipsis=True) == "a b" and spans.tail("a b, 石膏 !", 2) == "石膏 !" and spans.tail("a", 0) == ""


def plain_priority(items, most, coverage, order):
    if len(items) <= most:
        return {i["place"] for i in items}
    rank = {f: len(order) - k for k, f in enumerate(order)}
    taken, groups, docs = [], set(), set()
    key = lambda i, g, d: (rank.get(i["family"], 0), max(i["score"], 0), i["group_key"] not in g, i["doc_id"] is not None and i["doc_id"] not in d, i["internal"], -i["place"])
    for f in coverage:
        own = [i for i in items if i["family"] == f and i["place"] not in taken]
        if own and len(taken) < most:
            best = max(own, key=lambda i: key(i, groups, docs))
            taken.append(best["place"])
            groups.add(best["group_key"])
            docs.add(best["doc_id"])
    for i in sorted((i for i in items if i["place"] not in taken), key=lambda i: key(i, groups, docs), reverse=True):
        if len(taken) < most:
            taken.append(i["place"])
    return set(taken)


def test_priorities_and_numbering(spark):
    rng = random.Random(2)
    rows = [{"query_id": q, "place": p, "family": rng.choice(["kg", "vector", "multimodal", "external", "odd"]), "score": rng.choice([0.1, 0.2, -1.0]), "group_key": f"g{rng.randrange(4)}", "doc_id": rng.choice([None, 1, 2, 3]), "internal": rng.random() < 0.5} for q in range(30) for p in range(1, rng.randrange(2, 14))]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "query_id long, place int, family string, score double, group_key string, doc_id long, internal boolean").repartition(3)
    for profile, most in (("fast", 3), ("auto", 5), ("asset", 1), ("deep", 2)):
        coverage, order = context.family_order(profile)
        got = {}
        for r in context.prioritized(df, most, coverage, order).collect():
            got.setdefault(r.query_id, set()).add(r.place)
        assert got == {q: plain_priority([r for r in rows if r["query_id"] == q], most, coverage, order) for q in {r["query_id"] for r in rows}}
    n = context.numbered(spark.createDataFrame([(1, 1, 50), (1, 2, 0), (1, 3, 900), (2, 1, 0)], "query_id long, place int, tokens int"), 100)
    assert sorted((r.query_id, r.label, r.selected_tokens, r.truncated, r.n_clipped, r.n_skipped) for r in n.collect()) == [(1, "E1", 50, False, 1, 1), (1, "E2", 100, True, 1, 1)]


def test_blank_evidence_takes_no_place(spark):
    blank = [(1, f"b{k}", " ", "", None, 1.0, k, "section") for k in range(1, 9)]
    told = [(1, "x", "zzz", "", None, 1.0, 9, "section"), (1, "y", "nothing here", "", None, 1.0, 10, "section"), (1, "z", "alpha beta is the right answer.", "", None, 1.0, 11, "section")]
    evidence = spark.createDataFrame(blank + told, "query_id long, evidence_id string, text string, anchor string, path array<string>, score double, place int, record_type string")
    asked = spark.createDataFrame([(1, "alpha beta", None, True, ["section"])], "query_id long, query string, focus array<string>, needs_structure boolean, targets array<string>")
    assert A.best_sentences(asked, evidence).first().answer.startswith("alpha beta")
    assert A.structure_leads(asked.withColumn("focus", F.array(F.lit("alpha"))), evidence).first().answer == "alpha beta is the right answer"
    assert A.special_leads(asked, evidence).count() == 1
