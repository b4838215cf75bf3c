import random

import corpus_pipeline as p
from tests.llm.test_decontamination import prose
from tests.llm.test_near_dups import brute as brute_components


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(3)
    passage, item = " ".join(prose(rng, 60)), " ".join(prose(rng, 25))
    clean = {i: " ".join(prose(rng, rng.randrange(60, 150))) for i in range(200)}
    docs, labels = dict(clean), [(i, 1, 0) for i in range(0, 200, 2)]
    for i in range(200, 260):
        docs[i] = " ".join(w + "###" for w in prose(rng, 80))
        labels.append((i, 0, 0))
    for k in range(10):
        words = clean[k].split()
        words[10] = "changed"
        docs[300 + k] = " ".join(words)
        docs[320 + k] = " ".join(prose(rng, 40)) + " " + passage + " " + " ".join(prose(rng, 40))
        docs[340 + k] = " ".join(prose(rng, 40)) + " " + item.upper() + "! " + " ".join(prose(rng, 40))
    docs[400] = None
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs.items()] + [(None, clean[5] + " no id", None, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    at, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, at, folder).write.parquet(f"{folder}/{k}")
        at = spark.read.parquet(f"{folder}/{k}")
        seen.append({r.doc_id: r for r in at.collect()})
        if k < 4:
            assert at.columns == p.COLUMNS
    quality, near, cut, decon, mixed = seen
    assert not quality.keys() & set(range(200, 260)) and set(clean) <= quality.keys()
    groups = brute_components([(i, r.text) for i, r in quality.items() if i is not None], 5, 80)
    assert near.keys() == {i for i, (_, _, kept) in groups.items() if kept}  # the row without doc_id is nearly document 5
    assert sum(passage in (r.text or "") for r in cut.values()) == 1 and cut[320].text == docs[320]
    assert all(cut[i].text == clean[i] for i in clean) and all(r.n_chars == len(r.text or "") for i, r in cut.items() if i is not None)
    assert decon.keys() == cut.keys() - {340}  # the later copies of the item were cut as repeats
    assert mixed.keys() == decon.keys() and all(r.taken <= 2 * r["size"] for r in mixed.values())
    assert sorted(map(str, p.run(spark, folder).collect())) == sorted(map(str, mixed.values()))


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_rows_with_shared_and_missing_ids(spark, tmp_path):
    rng = random.Random(11)
    a, b, c, item = (" ".join(prose(rng, 60)) for _ in range(4))
    rows = [(3, b), (5, a), (5, b), (9, c), (9, c), (None, c), (None, a + " x"), (None, None), (None, None), (7, " ".join(prose(rng, 60)) + " " + item), (None, item), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string").repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    near = p.drop_near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == p.COLUMNS
    assert key(near.collect()) == sorted([(3, b), (5, a), (9, c), (None, None), (None, None), (7, rows[9][1]), (None, item), (4, "")], key=str)
    clean = p.drop_contaminated(spark, near, str(tmp_path))
    assert key(clean.collect()) == sorted([(3, b), (5, a), (9, c), (None, None), (None, None), (4, "")], key=str)
    assert p.cut_repeats(spark, clean, str(tmp_path)).columns == p.COLUMNS and p.mix(spark, clean, str(tmp_path)).count() == 6
