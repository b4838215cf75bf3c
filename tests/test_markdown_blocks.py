import pytest

from tessera.sources import markdown


def found(text):
    return [(b.kind, b.text) for b in markdown.captioned(list(markdown.blocks(text.split("\n"))))]


@pytest.mark.parametrize(
    "text, want",
    [
        ("# A #\ntext\nmore\n\n## B", [("heading", "A"), ("paragraph", "text\nmore"), ("heading", "B")]),
        ("Head\n====\nSub\n---\n---", [("heading", "Head"), ("heading", "Sub")]),
        ("#no\n##\n# C# #", [("paragraph", "#no"), ("heading", "C#")]),
        ("```py\n# no\n\n  x\n```\n~~~\nopen", [("code", "# no\nx"), ("code", "open")]),
        ("    a\n\n    b\nc", [("code", "a\nb"), ("paragraph", "c")]),
        ("- a\n  b\n- c\n\n    d\n1. e\n\nf", [("list_item", "a\nb"), ("list_item", "c"), ("paragraph", "d"), ("list_item", "e"), ("paragraph", "f")]),
        ("a | b\n--|--\n1 \\| x | 2 | 3\n4\n", [("table", "| a | b |\n|---|---|\n| 1 \\| x | 2 |"), ("paragraph", "4")]),
        ("a | b\n---\nc", [("heading", "a | b"), ("paragraph", "c")]),
        ("> # Q\n> said\nout", [("heading", "Q"), ("paragraph", "said"), ("paragraph", "out")]),
        ("<!-- a\nb -->\nx\n<!-- open", [("paragraph", "x\n<!-- open")]),
        ("[^1]: note\nmore\n\nx", [("footnote", "[^1]: note\nmore"), ("paragraph", "x")]),
        ("see [this](u 'x') **bold _it_** `a*b*c` \\*x\\* 2 * 3 * 4 snake_case_name", [("paragraph", "see [this](u 'x') bold it a*b*c *x* 2 * 3 * 4 snake_case_name")]),
        ("Table 2: sums\n\n|a|\n|-|\n|1|\n\nTable 1 is above", [("caption", "Table 2: sums"), ("table", "| a |\n|---|\n| 1 |"), ("paragraph", "Table 1 is above")]),
        ("图 1: 石膏板\n\n![](x.png)", [("caption", "图 1: 石膏板"), ("figure", "")]),
        ("", []),
        (" \n\t\n", []),
    ],
)
def test_blocks(text, want):
    assert found(text) == want


def test_sections_have_their_ranges():
    text = "lead\n# T\n## One\n石膏板\n\n|a|b|\n|-|-|\n|x|1|\n## Empty\n### Deep\n![alt](p.png)\n\nFigure 1. A plot\n## Two\nend[^1]\n\n[^1]: note"
    rows = list(markdown.parsed(text, "file"))
    sections = [r for r in rows if r["record"] == "section"]
    assert [(r["toc_path"], r["level"], r["text"]) for r in sections] == [
        (["T"], 1, "lead"),
        (["T", "One"], 1, "石膏板\n\n[ASSET_ANCHOR:t-one-table-1]"),
        (["T", "Empty", "Deep"], 2, "Figure 1. A plot"),
        (["T", "Two"], 1, "end[^1]"),
    ]
    visible = "\n\n".join(r["text"] for r in sections)
    assert all(visible[r["char_start"] : r["char_end"]] == r["text"] == visible.encode()[r["byte_start"] : r["byte_end"]].decode() for r in sections)
    kinds = [(r["kind"], r["element_id"]) for r in rows if r["record"] == "element"]
    assert ("figure", "t-empty-deep-figure-1") in kinds and ("caption", "t-empty-deep-caption-1") in kinds and len(kinds) == 10
    assert [r["text"] for r in markdown.parsed("", " A  b ")] == ["A b"] and [r["text"] for r in markdown.parsed("<!-- x -->", "")] == ["document"]


def test_long_texts_take_linear_time():
    for text in ("> " * 100_000, "<!-- " * 50_000 + "\n" + "<!--\n" * 50_000, "[" * 200_000, "`" * 200_000 + "x", "- " * 100_000, "|a|\n" * 50_000, "*" * 200_000 + "\n" + "_ " * 100_000, "# " + "#" * 200_000 + "x", "```\n" * 50_001):
        list(markdown.parsed(text, "t"))


@pytest.mark.parametrize(
    "text, rows, types",
    [
        ("| n | k | t |\n|---|---|---|\n| 1,000 | a | x y |\n| 5% | a | z |\n| | b | w |\n| 7 | b | v |\n| 8 | b | u |", 5, ["number(min=5, max=1000)", "enum(a, b)", "text"]),
        ("| n |  |\n|---|---|", 0, ["empty", "empty"]),
        ("no table", 0, []),
    ],
)
def test_profile(text, rows, types):
    got = markdown.profile(text)
    assert (got["row_count"], got["types"], got["column_count"]) == (rows, types, len(types))
    if rows == 0:
        assert got["preview"].endswith("Sample rows:\n(no data rows)")
    else:
        assert got["preview"].count("\n") == 9 and "| 1,000 | a | x y |" in got["preview"]


def test_records(spark):
    docs = spark.createDataFrame([(1, "# A\n|a|\n|-|\n|[ASSET_ANCHOR:b]|\n\n[ASSET_ANCHOR:none] said\n## B\n![](x)\n", None), (4, None, "again"), (2, "", None), (3, "![](x)", "t")], "`my key` int, text string, title string")
    docs = docs.withColumnRenamed("my key", "k")
    rows = markdown.parse(docs, "k", "text", "title").persist()
    sections = markdown.sections(rows, "k")
    got = {(r.k, r.order_index, r.section_text): (r.asset_refs, r.tables) for r in sections.collect()}
    assert got == {(1, 0, "[ASSET_ANCHOR:a-table-1]\n\n[ASSET_ANCHOR:none] said"): (["a-table-1", "none"], 1), (4, 0, "again"): ([], 0), (2, 0, "document"): ([], 0), (3, 0, "t"): ([], 0)}
    assets = {(r.k, r.element_id): (r.relation_type, r.section_index, r.row_count, r.preview) for r in markdown.asset_records(markdown.elements(rows, "k"), sections, "k").collect()}
    assert assets[1, "a-b-figure-1"] == ("figure_of", None, None, "figure") and assets[3, "t-figure-1"][1] == 0
    assert assets[1, "a-table-1"][:3] == ("table_of", 0, 1)
    assert markdown.parse(docs.limit(0), "k", "text", "title").count() == 0


def test_one_kind_of_rows_leaves_the_parser_in_parts(spark, monkeypatch):
    rows = [(i, None if i % 7 == 3 else f"# T{i}\n\nfirst  words\n\n" + "".join(f"## P{j}\n\nsome  text {j}\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n" for j in range(i % 9))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'none' AS title").repartition(2)
    want = sorted(map(str, markdown.parse(docs, "doc_id", "text", "title").collect()))
    monkeypatch.setattr(markdown, "SENT_ROWS", 3, raising=False)
    monkeypatch.setattr(markdown, "SENT_CHARS", 50, raising=False)
    assert sorted(map(str, markdown.parse(docs, "doc_id", "text", "title").collect())) == want
    parts = [markdown.parse(docs, "doc_id", "text", "title", kind) for kind in ("element", "section")]
    assert all({r.record for r in p.select("record").distinct().collect()} == {kind} for p, kind in zip(parts, ("element", "section")))
    assert sorted(map(str, parts[0].union(parts[1]).collect())) == want
