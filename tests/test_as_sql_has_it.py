"""Queries against their SQL on texts that the test tables have few of."""

import duckdb

from tessera import registry
from tessera.functions import text as T


def both(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        path = str(tmp_path / f"{t}.parquet")
        df.coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = registry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


def test_conflict_pairs_words_end_at_ascii_edges(spark, tmp_path):
    texts = ["noé waits here", "we wait here", "éno waits here", "石膏板 waits here", "not_ here", "石膏板 NO waits", None, "pas here", "nó here"]
    rows = [(c, 2 * i, "user", t) for c in (1, 2) for i, t in enumerate(texts)] + [(2, 3, "user", "石膏板 waits here")]
    got, want = both(spark, tmp_path, "conflict_pairs", conversations=spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert got == want and got


def test_web_titles_as_they_stand(spark, tmp_path):
    pages = ["<title>a&amp</title>", "<title> a &amp;\n\tb&ampc </title>", "<title>&amp;lt;&copy;&#65;</title>", "<TITLE>x</TITLE><h1>head</h1>", "<h1>head</h1>", "", None, "<title></title>", "<title>a b\u000bc </title>", "<title>x<title>y</title>", "<title>a\\1$1</title>"]
    df = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(pages)], "page_id long, url string, html string")
    got, want = both(spark, tmp_path, "web_titles", pages=df)
    assert got == want


def texts(spark):
    rows = [(i, f"head{i % 3} ALPHA 石膏板\nw{i % 5} x{i % 7} noé " + " ".join(f"t{j}" for j in range(i % 17))) for i in range(60)] + [(60, None), (61, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def items(spark):
    return spark.createDataFrame([(i, f"石膏板 head{i} alpha w1 x2 NOÉ " + " ".join(f"t{j}" for j in range(3 * i))) for i in range(8)] + [(8, None)], "item_id long, text string")


def test_term_queries_count_in_tiles(spark, tmp_path):
    for name in ("keyword_overlap", "lexical_sections"):
        got, want = both(spark, tmp_path / name, name, documents=texts(spark), benchmark=items(spark))
        assert got == want and got, name
        plan = registry.queries()[name](spark, str(tmp_path / name))._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode" not in plan, name


def test_slug_extracts_and_words_are_trimmed(spark, tmp_path):
    rows = ["  --Ab c石膏!x--  ", "...", None, "(A1),, [b].x; 、c。 ..,", "É9 é", "a", "x Y, (Z)"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got, want = both(spark, tmp_path / "text_slug", "text_slug", documents=df)
    assert got == want
    words = [r[0] for r in df.orderBy("doc_id").select(T._words("text")).collect()]
    assert words == [["--Ab", "c石膏!x--"], [], [], ["A1", "b].x", "c"], ["É9", "é"], ["a"], ["x", "Y", "Z"]]
    plan = registry.queries()["text_slug"](spark, str(tmp_path / "text_slug"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
