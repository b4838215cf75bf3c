import json

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.engine import Engine, configured
from tessera.functions import text as T


def test_ingest_query_delete_rebuild(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/e")
    docs = lambda *x: spark.createDataFrame(list(x), "location string, title string, text string, source_type string")
    asked = spark.createDataFrame([(1, "when do sales of plaster rise"), (2, "石膏板 销量"), (3, "zzz qqq")], "query_id long, text string")
    assert e.answer(asked).count() == 3 and e.stats() == {"documents": 0, "active": 0, "sections": 0}
    rows = [("a", "A", "Nothing much here. Sales of plaster rise in spring.", "plain_text"), ("b", None, "石膏板 的 销量 很高。其他内容。", "plain_text"), ("c", "C", " ", "plain_text"), ("d", "D", "alpha beta " * 400, "plain_text")]
    assert e.ingest(docs(*rows)) == {"processed": 4, "new": 3, "unchanged": 0, "empty": 1}
    assert e.ingest(docs(*rows)) == {"processed": 4, "new": 0, "unchanged": 3, "empty": 1}
    before = e.stats()
    assert before["documents"] == before["active"] == 3 and before["sections"] > 6
    got = {r.query_id: r for r in e.answer(asked).collect()}
    assert got[1].answer == "Sales of plaster rise in spring." and len(got[1].citations) == 1 and not got[1].insufficient
    assert got[2].answer.startswith("石膏板") and got[3].insufficient and got[3].citations == []
    found = e.retrieve(asked)
    d = {r.query_id: r for r in e.diagnostics(found).collect()}
    assert d[1].lexical == 1 and d[1].dense >= 3
    ids = {r.location: r.doc_id for r in e.documents.read().collect()}
    assert e.ingest(docs(("a", "A", "Sales of plaster rise in autumn now.", "plain_text")))["new"] == 1
    assert {r.query_id: r.answer for r in e.answer(asked).collect()}[1] == "Sales of plaster rise in autumn now." and e.stats()["active"] == 3
    assert e.delete([ids["b"]]) == 1 and {r.query_id: r.insufficient for r in e.answer(asked).collect()}[2] and e.delete([]) == 0
    assert e.rebuild([ids["b"], 12345]) == 1 and not {r.query_id: r.insufficient for r in e.answer(asked).collect()}[2]
    qrels = spark.createDataFrame([(2, ids["b"], 1), (3, ids["d"], 1)], "query_id long, doc_id long, relevance int")
    assert {r.query_id: r.hit for r in e.evaluate(asked, qrels, 1).collect()}[2] == 1


def test_stored_texts_are_neither_embedded_nor_cut_again(spark, tmp_path):
    from dataclasses import replace

    calls = []

    def embed(column):
        calls.append(column)
        return T.hash_embedding(column, 16)

    e = Engine(spark, f"{tmp_path}/e", replace(configured(), embed=embed))
    rows = [(f"p/{i}.md", f"T{i}", f"paper {i} tells of w{i % 7} and of w{i % 3}", "markdown" if i % 2 else "plain_text") for i in range(40)]
    e.ingest(spark.createDataFrame(rows, "location string, title string, text string, source_type string"))
    asked = spark.createDataFrame([(1, "w3 w1"), (2, "w6")], "query_id long, text string")
    calls.clear()
    whole = e.retrieve(asked, 5)
    assert len(calls) == 1 and whole.count() == 10  # the queries' texts only
    odd = {r.title for r in e.retrieve(asked, 5, F.col("source_type") == "markdown").collect()}
    assert odd and all(int(t[1:]) % 2 for t in odd)
    lexical = [r.title for r in e.retrieve(asked, 20, F.col("order_index") == 0).where("query_id = 2 and array_contains(branches, 'section')").collect()]
    assert sorted(lexical) == sorted(f"T{i}" for i in range(40) if i % 7 == 6)
    e.documents.update(F.col("location") == "p/6.md", {"is_active": F.lit(False)})  # hidden behind the index's back
    lexical = [r.title for r in e.retrieve(asked, 20).where("query_id = 2 and array_contains(branches, 'section')").collect()]
    assert sorted(lexical) == sorted(f"T{i}" for i in range(40) if i % 7 == 6 and i != 6)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.md").write_text("# Title\n\nThe moon is made of rock.")
    (tmp_path / "in" / "y.txt").write_text("Cheese is made of milk.")
    root = f"{tmp_path}/e"

    def said(*arguments):
        assert main(list(map(str, arguments)), spark) == 0
        return [json.loads(x) for x in capsys.readouterr().out.strip().split("\n") if x.startswith("{")]

    assert said("ingest", root, tmp_path / "in") == [{"processed": 2, "new": 2, "unchanged": 0, "empty": 0}]
    assert said("query", root, "what is cheese made of")[0]["answer"] == "Cheese is made of milk."
    top = said("query", root, "moon rock", "--evidence")[0]
    assert "moon" in top["section_text"] and said("stats", root) == [{"documents": 2, "active": 2, "sections": 2}]
    assert said("delete", root, top["doc_id"]) == [{"documents": 1}] and said("rebuild", root, top["doc_id"]) == [{"documents": 1}]
    (tmp_path / "d.jsonl").write_text('{"doc_id": "p1", "title": "P", "text": "gypsum boards"}\n{"doc_id": "p2", "title": "steel beams", "text": ""}\n')
    (tmp_path / "q.jsonl").write_text('{"query_id": "1", "query_text": "gypsum"}\n{"query_id": "2", "query_text": "steel"}\n')
    (tmp_path / "r.jsonl").write_text('{"qid": "1", "pid": "p1", "score": 1}\n{"qid": "2", "pid": "p2", "score": 1}\n')
    assert said("benchmark-ingest", f"{tmp_path}/b", tmp_path / "d.jsonl")[0]["new"] == 2
    report = said("benchmark-evaluate", f"{tmp_path}/b", tmp_path / "q.jsonl", tmp_path / "r.jsonl", "--top-k", 1, "--history", tmp_path / "h")[0]
    assert report["queries"] == 2 and report["hit"] == 1.0 and spark.read.json(f"{tmp_path}/h").count() == 1
    assert main(["benchmark-subset", str(tmp_path / "d.jsonl"), str(tmp_path / "q.jsonl"), str(tmp_path / "r.jsonl"), f"{tmp_path}/s", "--queries-wanted", "1", "--documents-wanted", "1"], spark) == 0
    assert spark.read.json(f"{tmp_path}/s/documents").count() == 1
    assert {p["profile"] for p in said("profiles")} == {"local_full", "local_retrieval_cloud_chat", "cloud_full", "test_minimal"} and main(["run", "nope", "x"], spark) == 2
    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert main(["export", root, f"{tmp_path}/x"], spark) == 0 and spark.read.json(f"{tmp_path}/x").count() == 2


def test_configuration():
    c = configured("local_full", {"top_k": 3, "alpha": None}, {"TESSERA_TOP_K": "7", "TESSERA_WINDOW_TOKENS": "99", "TESSERA_ALPHA": ""})
    assert (c.top_k, c.window_tokens, c.alpha, c.chat) == (3, 99, 0.65, "local")
    with pytest.raises(ValueError, match="no profile"):
        configured("nope")
