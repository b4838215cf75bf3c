import random
import re

from pyspark.sql import functions as F

from tessera.functions import spans
from tessera.operators import sections as S

ANCHOR = "[ASSET_ANCHOR:table-1]"


def test_anchors_stay_whole_and_stand_once():
    rng = random.Random(1)
    for _ in range(300):
        refs = [f"[ASSET_ANCHOR:{rng.choice(['table', 'figure'])}-{k}]" for k in range(rng.randrange(0, 5))]
        words = ["w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))]
        for r in refs:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["", "x"]) + r)
        text = " ".join(words)
        size, overlap = rng.randrange(2, 15), rng.randrange(0, 4)
        found = S.refined(text, size, min(overlap, size - 1))
        parts = [text[lo:hi] for _, _, lo, hi in found]
        joined = "\0".join(parts)
        assert joined.count("[") == len(re.findall(S.ANCHOR, joined)) == joined.count("]") or not found
        if found:
            assert all(joined.count(r) <= 1 for r in refs)
            assert len(spans.token_spans(text)[0]) > size


def test_refine_and_records(spark):
    long = " ".join(f"t{k}" for k in range(30))
    rows = [(1, long), (2, "short"), (3, f"aa bb {ANCHOR} cc dd ee ff gg hh ii jj"), (4, None), (5, "")]
    parts = S.refine(spark.createDataFrame(rows, "section_id long, text string"), "section_id", "text", 10, 2)
    got = {}
    for r in parts.collect():
        got.setdefault(r.section_id, []).append(r)
    one = sorted(got[1], key=lambda r: r.window_index)
    assert [(r.token_start, r.token_end, r.window_count) for r in one] == [(0, 10, 4), (8, 18, 4), (16, 26, 4), (24, 30, 4)]
    assert all(long[r.char_start : r.char_end] == r.section_text for r in one)
    assert [(r.window_count, r.section_text) for k in (2, 4, 5) for r in got[k]] == [(1, "short"), (1, ""), (1, "")]
    records = {(r.section_id, r.window_index): r for r in S.section_records(parts, "section_id", F.concat(F.lit("s"), F.col("section_id").cast("string")), F.lit(100)).collect()}
    assert records[(1, 1)].anchor == "s1-part-2" and records[(1, 1)].char_range_start == 100 + one[1].char_start and records[(2, 0)].anchor == "s2"
    three = [r for (k, _), r in records.items() if k == 3]
    assert sum(r.has_table for r in three) == 1 and sum(ANCHOR in r.section_text for r in three) == 1 and not any(r.has_figure for r in three)


def world(spark):
    bodies = {i: " ".join(f"word{i}x{k}" for k in range(300)) if i == 2 else f"Section {i} about topic{i}. See [ASSET_ANCHOR:table-{i}]" for i in range(6)}
    data, ranges, at = "", [], 0
    for i, b in bodies.items():
        raw = ("é" + b + "\n").encode()
        ranges.append((i, 7, i, "obj", at + 2, at + len(raw) - 1))
        data, at = data + "é" + b + "\n", at + len(raw)
    ranges += [(10, 8, 0, "gone", 0, 5), (11, 8, 1, None, 0, 5), (12, 8, 2, "obj", 9, 9)]
    sections = spark.createDataFrame(ranges, "section_id long, doc_id long, order_index int, object_key string, byte_start int, byte_end int")
    objects = spark.createDataFrame([("obj", bytearray(data.encode()))], "object_key string, content binary")
    assets = spark.createDataFrame([(1, 50, "[ASSET_ANCHOR:table-1]", "a table of topic1."), (1, 51, "", "second"), (1, 52, None, "third"), (3, 53, "[ASSET_ANCHOR:table-3]", None)], "section_id long, asset_id long, anchor string, asset_text string")
    return bodies, sections, objects, assets


def test_texts_anchors_and_neighbours(spark):
    bodies, sections, objects, assets = world(spark)
    texts = S.with_assets(S.section_texts(sections, objects), assets)
    got = {r.section_id: r.section_text for r in texts.collect()}
    assert got[0] == bodies[0] and got[1] == "Section 1 about topic1. See a table of topic1." and got[3] == "Section 3 about topic3. See "
    assert got[10] == "[CONTENT_UNAVAILABLE:section_id=10]" and got[11] == "" and got[12] == ""
    near = sorted((r.section_id, r.neighbour_id, r.place) for r in S.neighbours(sections.where("doc_id = 7")).collect())
    assert near[:3] == [(0, 1, 1), (1, 0, 1), (1, 2, 2)] and len(near) == 10


def test_grounding(spark):
    bodies, sections, objects, assets = world(spark)
    texts = S.with_assets(S.section_texts(sections, objects), assets).select("section_id", "section_text")
    items = spark.createDataFrame([(1, "topic1 table", 1, 0.5), (1, "topic1 table", 0, 0.4), (2, "word2x1 word2x299", 2, 0.1)], "query_id long, query string, section_id long, score double")
    found = S.ground_sections(items, sections, texts, assets).collect()
    first = sorted((r for r in found if r.query_id == 1), key=lambda r: r["rank"])
    assert first[0].evidence_id in ("grounded:section:1:1", "grounded:asset:50") and {r.evidence_id for r in first[:2]} == {"grounded:section:1:1", "grounded:asset:50"}
    assert "grounded:asset:51" in {r.evidence_id for r in first} and "grounded:asset:52" not in {r.evidence_id for r in first}
    assert len(first) <= 10 and len({r.evidence_id for r in first}) == len(first) and all(not r.text.endswith(".") for r in first)
    second = {r.evidence_id: r for r in found if r.query_id == 2}
    assert second["grounded:section:2:1"].local_score == 0.15 and "grounded:section:2:2" in second and {r.source for r in second.values()} >= {"hit", "neighbour"}
    docs = spark.createDataFrame([(5, "topic4", 7, 0.2)], "query_id long, query string, doc_id long, score double")
    best = [r.section_id for r in S.best_sections(docs, sections, texts).orderBy("section_id").collect()]
    assert best == [0, 4]
    assert "grounded:section:4:1" in {r.evidence_id for r in S.ground_documents(docs, sections, texts, assets).collect()}
    hits = spark.createDataFrame([(9, "topic1", 50, 0.3), (9, "x", 53, 0.3)], "query_id long, query string, asset_id long, score double")
    assert [(r.evidence_id, r.local_score) for r in S.ground_assets(hits, assets).collect()] == [("grounded:asset:50", 0.35)]


def test_compute_block_and_asset_text(spark):
    df = spark.createDataFrame([(4, "Sheet1", 10, 2, [("name", "text"), ("score", "number")], None)], "a int, s string, r int, c int, f array<struct<name:string,type:string>>, t int")
    block = df.select(S.compute_block(*(F.col(x) for x in ("a", "s", "r", "c", "f", "t"))).alias("x")).first().x.split("\n")
    assert block[0] == "[TABLE_COMPUTE_ONLY:asset_id=4]" and block[2] == "Shape: 10 rows x 2 columns" and block[3].startswith("Estimated full size: ~? tokens") and block[6] == "  " + "name".ljust(40) + " -> text"
    rows = [(" p ", "c", b"x"), (" ", "c ", b"x"), (None, None, b"y" * 5000), (None, "", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, c string, b binary").select(S.asset_text(F.col("p"), F.col("c"), F.col("b"))).collect()]
    assert got[:2] == ["p", "c"] and len(got[2]) == 4096 and got[3] is None


def test_every_hit_keeps_its_evidence(spark):
    """Four hits of one query, one on a section that isn't there: caps are each item's own, then the budget cuts."""
    bodies, sections, objects, assets = world(spark)
    texts = S.with_assets(S.section_texts(sections, objects), assets).select("section_id", "section_text")
    hits = [(1, "topic1 word2x1", k, 1.0 - k / 10, k + 1, f"e{k}", f"own text {k}") for k in (0, 4, 77, 2)]
    items = spark.createDataFrame([(q, a, s, x, p, e, t) for p, (q, a, s, x, _, e, t) in enumerate(hits, 1)], "query_id long, query string, section_id long, score double, place int, evidence_id string, text string")
    three = S.ground_sections(items, sections, texts, assets).collect()
    assert {r.place for r in three} == {1, 2, 3} and [r.text for r in three if r.place == 3] == ["own text 77"] and [r.evidence_id for r in three if r.place == 3] == ["e77"]
    every = S.ground_sections(items, sections, texts, assets, targets=9).collect()
    assert {r.place for r in every} == {1, 2, 3, 4} and len({r.evidence_id for r in every}) == len(every)
    assert {f"grounded:section:{k}:1" for k in (0, 4, 2, 5)} <= {r.evidence_id for r in every}
    some = sorted(S.ground_sections(items, sections, texts, assets, targets=9, tokens=20).collect(), key=lambda r: (r.place, r["rank"]))
    assert sum(r.n_tokens for r in some) == 20 and some[-1].text.endswith(" ...") and [r.evidence_id for r in some] == [r.evidence_id for r in sorted(every, key=lambda r: (r.place, r["rank"]))][: len(some)]
    docs = spark.createDataFrame([(5, "topic4", 7, 0.9), (5, "topic4", 99, 0.8)], "query_id long, query string, doc_id long, score double").withColumn("text", F.lit("hit"))
    found = {r.evidence_id: r for r in S.ground_documents(docs, sections, texts, assets).collect()}
    assert found["doc:99"].text == "hit" and found["grounded:section:4:1"].place == 1 and len(found) > 2
    lost = spark.createDataFrame([(9, "x", 53, 0.3), (9, "x", 500, 0.2)], "query_id long, query string, asset_id long, score double").withColumn("text", F.lit("hit"))
    assert sorted(r.text for r in S.ground_assets(lost, assets).collect()) == ["hit", "hit"]


def test_neighbours_share_parent_path_and_windows(spark):
    rows = [
        (1, 7, 3, 100, ["a"], 0, None), (2, 7, 3, 100, ["a"], 5, None), (3, 7, 3, 100, ["a"], 9, None), (4, 7, 3, 100, ["b"], 6, None), (5, 7, 3, None, ["a"], 1, None), (6, 7, 4, 100, ["a"], 2, None),
        (10, 8, 3, 200, None, 4, 0), (11, 8, 3, 200, None, 3, 1), (12, 8, 3, 200, None, 2, 2), (13, 8, 3, 200, None, 1, 5), (14, 8, 3, 201, None, 0, 1),
    ]
    sections = spark.createDataFrame(rows, "section_id long, doc_id long, source_id long, parent_section_id long, toc_path array<string>, order_index int, window_index int")
    got = {}
    for r in sorted(S.neighbours(sections).collect(), key=lambda r: r.place):
        got.setdefault(r.section_id, []).append(r.neighbour_id)
    assert got == {1: [2], 2: [1, 3], 3: [2], 10: [11], 11: [10, 12], 12: [11]}
    assert sorted(r.neighbour_id for r in S.neighbours(sections, 4, 9).where("section_id = 11").collect()) == [10, 12, 13]


def test_tables_stand_as_their_blocks(spark):
    sections = spark.createDataFrame([(1, f"See {ANCHOR}.")], "section_id long, section_text string")
    assets = spark.createDataFrame([(1, 50, ANCHOR, "rows of it", "[TABLE_COMPUTE_ONLY:asset_id=50]")], "section_id long, asset_id long, anchor string, asset_text string, anchor_text string")
    assert S.with_assets(sections, assets).first().section_text == "See [TABLE_COMPUTE_ONLY:asset_id=50]."
