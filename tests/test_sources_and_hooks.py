import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.plans import loops, sandbox
from tessera.sources import files, office

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def para(text, style=None):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def test_office_files(spark, tmp_path):
    body = para("lead") + para("One", "Heading1") + para("x") + para("Two", "heading 2") + "<w:tbl><w:tr><w:tc>" + para("a") + "</w:tc><w:tc>" + para("b") + "</w:tc></w:tr></w:tbl>" + para("y")
    docx = packed(word__document_xml=f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    found = office.parse_docx(docx)
    assert [(s["toc_path"], s["kind"], s["section_text"]) for s in found] == [([], "text", "lead"), (["One"], "text", "x"), (["One", "Two"], "table", "| a | b |"), (["One", "Two"], "text", "y")]
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp></p:sld>'
    pptx = packed(ppt__slides__slide10_xml=slide("ten"), ppt__slides__slide2_xml=slide("two"), ppt__slides__slide3_xml=slide(""), ppt__notesSlides__notesSlide2_xml='<n xmlns:a="a"><a:t>said</a:t></n>')
    assert [(s["toc_path"], s["section_text"]) for s in office.parse_pptx(pptx)] == [(["Slide 2"], "two\nNotes: said"), (["Slide 10"], "ten")]
    cell = lambda r, v, t="": f'<c r="{r}"{t}><v>{v}</v></c>'
    s = ' t="s"'
    rows = f'<row>{cell("A1", 0, s)}{cell("C1", 1, s)}{cell("B1", 2, s)}</row>' + "".join(f'<row>{cell(f"A{k}", 3, s)}{cell(f"B{k}", k)}{cell(f"C{k}", 1.5 * k)}</row>' for k in range(2, 8))
    xlsx = packed(xl__workbook_xml='<w><sheets><sheet name="Data"/><sheet name="Empty"/></sheets></w>', xl__sharedStrings_xml="<s><si><t>Name</t></si><si><t>Score</t></si><si><t>Age</t></si><si><t>bob</t></si></s>", xl__worksheets__sheet1_xml=f"<w><sheetData>{rows}</sheetData></w>", xl__worksheets__sheet2_xml="<w><sheetData/></w>")
    assert office.sheets(xlsx)[0][1][:2] == [["Name", "Age", "Score"], ["bob", "2", "3.0"]] and len(office.sheets(xlsx)) == 1
    for name, content in (("a.docx", docx), ("b.PPTX", pptx), ("c.xlsx", xlsx), ("bad.docx", b"no zip"), ("skip.txt", b"x")):
        (tmp_path / name).write_bytes(content)
    got = office.read(spark, str(tmp_path)).collect()
    assert len(got) == 4 + 2 + 1 + 1 and sum(r.error is not None for r in got) == 1
    assert next(r.section_text for r in got if r.path.endswith("xlsx")) == "columns: Name, Age, Score\nrows: 7"


class Length:
    def embed(self, texts):
        return [[len(t), 1] for t in texts]

    def rerank(self, query, documents):
        return [float(len(d)) if query == "long" else -float(len(d)) for d in documents]

    def generate_text(self, prompt):
        if not prompt:
            raise ValueError("empty")
        return prompt.upper()


class Short(Length):
    def embed(self, texts):
        return []


def test_model_hooks(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "k int, t string")
    got = df.select("k", hooks.embedder(Length)("t").alias("v"), hooks.generator(Length)("t").alias("g")).orderBy("k").collect()
    assert [r.v for r in got] == [[2.0, 1.0], [0.0, 1.0], [3.0, 1.0]] and [r.g for r in got] == ["AB", None, "ABC"]
    with pytest.raises(Exception, match="0 results for"):
        df.select(hooks.embedder(Short)("t")).collect()
    rows = [(q, t, f"c{i}", 1.0 - i / 100, "x" * (i + 1)) for q, t in ((1, "long"), (2, "short")) for i in range(30)]
    out = hooks.rerank(spark.createDataFrame(rows, "query_id int, query_text string, candidate_id string, score double, text string"), Length, pool=20, batch=7).collect()
    assert len(out) == 60 and sum(r.rerank_score is None for r in out) == 20
    assert all(r.rerank_score == (len(r.text) if r.query_id == 1 else -len(r.text)) for r in out if r.rerank_score is not None)
    assert hooks.provider_order(["a", "b"], ["c", "a"], "local_preferred") == ["a", "b", "c"] and hooks.provider_order(["a"], ["c"], "local_required") == ["a"]
    assert hooks.merged_config({"x": None, "y": 1}, {"x": 2, "y": 3}) == {"x": 2, "y": 1}


def test_loops(spark):
    p = spark.createDataFrame([(1, "a b c d", "a b", "a"), (2, "a", "a", "a"), (3, "a b c", "a b c", "a b c")], "query_id int, full string, compact string, minimal string")
    assert {r.query_id: (r.style, r.prompt) for r in loops.shrink_to_budget(p, ["full", "compact", "minimal"], 2).collect()} == {1: ("compact", "a b"), 2: ("full", "a"), 3: ("minimal", "a b c")}
    tasks = spark.createDataFrame([(k, k) for k in range(1, 6)], "task_id int, hard int")
    tried = lambda t, n: t.select("task_id", (F.col("hard") <= n).alias("accepted"), F.lit(n).alias("result"))
    got = {r.task_id: (r.accepted, r.attempts) for r in loops.retried(tasks, tried, 2).collect()}
    assert got == {1: (True, 1), 2: (True, 2), 3: (True, 3), 4: (False, 3), 5: (False, 3)}
    out = loops.computed([("a", "SELECT max(hard) AS m FROM sheet"), ("a", "SELECT 1"), ("b", "DROP TABLE sheet"), ("c", "SELECT nope FROM sheet"), ("d", "SELECT 1")], lambda n: None if n == "d" else tasks)
    assert out["a"].first().m == "5" and out["b"] is None and out["c"] is None and out["d"] is None
    rows = sandbox.rendered(sandbox.select(spark.range(150).toDF("x"), "SELECT x FROM sheet")).collect()
    assert len(rows) == 100 and rows[0].raw_rows == 150 and rows[0].truncated
    for bad in ("", "WITH x AS (SELECT 1) SELECT 1", "SELECT 1; SELECT 2", "select 'drop'"):
        with pytest.raises(sandbox.SqlRejected):
            sandbox.validate(bad)


def test_mini_subset_matches_brute_force(spark):
    docs = [(i, "en") for i in range(60)]
    judged = [(q, d, 1 + d % 2) for q in range(30, 36) for d in range(q - 30, 60, 6)] + [(q, q, 0) for q in range(30)]
    hashes = lambda n: {r.k: r.h for r in spark.range(n).select(F.col("id").alias("k"), F.xxhash64(F.lit(7), "id").alias("h")).collect()}
    order = hashes(60)
    for n_queries, n_docs in ((2, 30), (4, 15), (50, 60), (1, 0)):
        got, subset = files.mini_subset(*(spark.createDataFrame(x, y) for x, y in ((docs, "doc_id long, lang string"), ([(q,) for q in range(36)], "query_id long"), (judged, "query_id long, doc_id long, relevance int"))), n_queries, n_docs)
        chosen = sorted({q for q, _, r in judged if r > 0}, key=lambda q: (order[q], q))[:n_queries]
        gold = {d for q, d, r in judged if q in chosen and r > 0}
        fill = sorted({d for d, _ in docs} - gold, key=lambda d: (order[d], d))[: max(n_docs - len(gold), 0)]
        assert sorted(r.query_id for r in got.collect()) == sorted(chosen)
        assert sorted(r.doc_id for r in subset.collect()) == sorted(gold | set(fill))


def test_sandbox_statements_run_or_are_refused(spark, tmp_path):
    from tessera.queries_sandbox import GUARDED, STATEMENTS

    spark.range(3).write.parquet(f"{tmp_path}/x")
    spark.range(3).createOrReplaceTempView("secret")
    sheet = spark.range(5).selectExpr("id AS a", "id AS b", "'e' AS e", "DATE'2020-01-01' AS d", "id AS c")
    for statement, ok in GUARDED:
        if ok:
            sandbox.select(sheet, statement).collect()
    for bad in (f"SELECT * FROM parquet.`{tmp_path}/x`", "SELECT * FROM secret", "SELECT * FROM `secret`", "SELECT * FROM sheet JOIN LATERAL (SELECT 1)", "SELECT * FROM global_temp.secret", "SELECT * FROM sheet WHERE a = (FROM secret)", "SELECT * FROM secret WINDOW w AS (ORDER BY id), secret AS (ORDER BY id)", "SELECT * FROM (WITH x AS (SELECT * FROM secret) SELECT * FROM x) y"):
        with pytest.raises(sandbox.SqlRejected):
            sandbox.select(sheet, bad)
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"
    for _, statement in STATEMENTS.values():
        sandbox.validate(statement)


def test_sandbox_results_and_time_limit(spark):
    got = sandbox.compute(spark.range(150).toDF("x"), "SELECT x, 'v' AS y FROM sheet ORDER BY x", "a7", seconds=60)
    assert (got.columns, len(got.rows), got.raw_rows, got.truncated) == (["x", "y"], 100, 150, True)
    assert got.markdown().startswith("[TABLE_COMPUTE_RESULT:asset_id=a7]\nComputation executed in ") and "| x | y |\n|---|---|\n| 0 | v |" in got.markdown()
    assert "(Showing first 100 rows of 150 total)" in got.markdown()
    big = spark.range(200_000_000).toDF("x")
    with pytest.raises(sandbox.SqlTimeout):
        sandbox.compute(big, "SELECT count(DISTINCT repeat(CAST(s.x AS STRING), 9)) FROM sheet s JOIN sheet t ON s.x = t.x + 1", seconds=0.5)
    assert sandbox.compute(spark.range(2).toDF("x"), "SELECT sum(x) AS s FROM sheet", seconds=60).rows == [["1"]]


class Speaker:
    def generate_text(self, prompt):
        if prompt == "fail":
            raise KeyError("tired")
        return f'Sure: {{"n": {len(prompt)}}} bye'

    def extract(self, image):
        return image.decode()


def test_reasons_structure_and_images(spark):
    df = spark.createDataFrame([(1, "ab", bytearray(b"x")), (2, "fail", None)], "k int, t string, b binary")
    got = df.select("k", hooks.told(Speaker)("t").alias("g"), hooks.structured_generator(Speaker, "n int", ("n",))("t").alias("s"), hooks.described(Speaker)("b").alias("o")).orderBy("k").collect()
    assert got[0].g.text.startswith("Sure") and got[0].s.n == 2 and got[0].o == "x" and got[1].g.text is None and got[1].g.error == "KeyError: 'tired'" and got[1].s is None and got[1].o is None
    assert hooks.picked("chat", None, {}, {"chat": "c"}, {"PROVIDER_CHAT": "e"}) == "c" and hooks.picked("chat", None, {}, {}, {"PROVIDER_CHAT": "e"}) == "e" and hooks.picked("x", None, {}, {}, {}, "d") == "d"


def test_compute_loop_and_written_attempts(spark, tmp_path):
    sheet = spark.range(4).toDF("x")
    said = iter(['<compute_request>{"asset_id": 7, "sql": "SELECT sum(x) AS s FROM sheet"}</compute_request>', "it is 6", "plain", '<compute_request>{"asset_id": 9, "sql": "DROP x"}</compute_request>', "no"])
    prompts = []

    def model(prompt):
        prompts.append(prompt)
        return next(said)

    assert loops.answered({"a": "A", "b": "B", "c": "C"}, model, lambda name: sheet) == {"a": "it is 6", "b": "plain", "c": "no"}
    assert "| s |\n|---|\n| 6 |" in prompts[1] and "SqlRejected" in prompts[4]
    out = loops.results([("a", "SELECT nope FROM sheet"), ("b", "SELECT 1 AS k"), ("c", "SELECT 1")], lambda n: None if n == "c" else sheet)
    assert out["a"][0] is None and "AnalysisException" in out["a"][1] and out["b"][0].rows == [["1"]] and out["c"] == (None, "no such asset")
    calls = spark.sparkContext.accumulator(0)

    def attempt(tasks, n):
        def count(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return tasks.mapInArrow(count, tasks.schema).select("task_id", (F.col("task_id") <= n).alias("accepted"), F.lit(n).alias("result"))

    done = loops.retried(spark.createDataFrame([(1,), (2,), (3,)], "task_id int"), attempt, 4, str(tmp_path))
    assert sorted((r.task_id, r.attempts) for r in done.collect()) == [(1, 1), (2, 2), (3, 3)] and done.count() == 3 and calls.value == 6


def test_files_and_records(spark, tmp_path):
    for name in ("b.MD", "a.txt", ".hidden.txt", "c.xls", "d.webp", "sub/e.pdf"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("x")
    found = [(r.file_name, r.source_type, r.title) for r in files.discover(spark, str(tmp_path / "in"), "me").collect()]
    assert found == [("a.txt", "plain_text", "a"), ("b.MD", "markdown", "b"), ("d.webp", "image", "d"), ("e.pdf", "pdf", "e")]
    assert len(files.discover(spark, str(tmp_path / "in"), "me", recursive=False).collect()) == 3
    types = spark.createDataFrame([("x.md", "markdown"), ("x.bin", "web"), ("x.pdf", None)], "l string, d string").select(files.declared_type(F.col("l"), F.col("d")).alias("t")).collect()
    assert [r.t for r in types] == ["markdown", "web", "pdf"]
    with pytest.raises(Exception, match="declared as web"):
        spark.createDataFrame([("x.md", "web")], "l string, d string").select(files.declared_type(F.col("l"), F.col("d"))).collect()
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\td1\t2\n2\td2\t\n")
    (tmp_path / "q.jsonl").write_text('{"qid": "1", "pid": "p", "score": 1}\n{"query_id": "2", "doc_id": "d", "relevance": 3}\n')
    assert [tuple(r) for r in files.read_qrels(spark, str(tmp_path / "q.tsv")).orderBy("query_id").collect()] == [("1", "d1", 2), ("2", "d2", 0)]
    assert [tuple(r) for r in files.read_qrels_jsonl(spark, str(tmp_path / "q.jsonl")).orderBy("query_id").collect()] == [("1", "p", 1), ("2", "d", 3)]
    docs = spark.createDataFrame([(1, None, "t", None), (2, "T", " ", {"benchmark_doc_id": "x"})], "doc_id long, title string, text string, metadata map<string,string>")
    assert [(r.title, r.text, r.metadata) for r in files.with_defaults(docs).orderBy("doc_id").collect()] == [("1", "t", {"benchmark_doc_id": "1"}), ("T", "T", {"benchmark_doc_id": "x"})]
    old = spark.createDataFrame([(1, "a")], "run int, note string")
    assert files.append_rows(old, spark.createDataFrame([(2, 0.5)], "run int, ndcg double")).columns == ["run", "note", "ndcg"]


def test_sandbox_reads_nothing_of_the_session(spark):
    """What passes the parser is held against the analysed plan too: views, functions and variables of the session."""
    from tessera.plans.sandbox import SqlRejected, select

    spark = spark.newSession()  # whose functions and variables are its own
    sheet = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    spark.createDataFrame([(7, "hidden")], "id long, name string").createOrReplaceTempView("secret")
    spark.udf.register("abs", lambda x: "from a function of the session")
    spark.sql("DECLARE OR REPLACE VARIABLE inner_value STRING DEFAULT 'hidden'")
    for bad in ("SELECT inner_value FROM sheet", "SELECT abs(id) FROM sheet", "SELECT user FROM sheet", "SELECT id FROM sheet WHERE id = (SELECT max(abs(id)) FROM sheet)", "SELECT * FROM secret"):
        with pytest.raises(SqlRejected):
            select(sheet, bad)
    good = "SELECT s.id, t.n FROM (WITH secret AS (SELECT id FROM sheet) SELECT * FROM secret) s JOIN (SELECT id, count(*) AS n FROM sheet GROUP BY ALL) t USING (id) ORDER BY 1"
    assert [tuple(r) for r in select(sheet, good).collect()] == [(1, 1), (2, 1)]
    assert select(sheet.withColumnRenamed("name", "user"), "SELECT user FROM sheet ORDER BY 1").collect()[0][0] == "a"
    loop = "SELECT * FROM (WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r)"
    assert sorted(r[0] for r in select(sheet, loop).collect()) == [1, 2, 3]
