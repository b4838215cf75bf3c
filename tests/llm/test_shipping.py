"""Public functions work in a fresh session whose workers can't import the package from the current folder."""

import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
docs = spark.createDataFrame([(i, f"some words of text number {i} " * 5) for i in range(8)], "doc_id long, text string")
labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
bench = spark.createDataFrame([(1, "words of text number 3 some words of text")], "item_id long, text string")
turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
which = sys.argv[3]
if which == "quality_rules":
    from tessera.llm.quality_rules import compression_bands
    out = compression_bands(docs)
elif which == "near_dups":
    from tessera.llm.near_dups import near_duplicates
    out = near_duplicates(docs)
elif which == "repeats":
    from tessera.llm.repeats import digest_repeats, remove_repeats
    assert remove_repeats(docs).count() == 8
    out = digest_repeats(docs)
elif which == "decontamination":
    from tessera.llm.decontamination import contaminated, without_contaminated
    without_contaminated(docs, bench).count()
    out = contaminated(docs, bench).unionByName(contaminated(docs, bench)).limit(8)
elif which == "chat":
    from tessera.llm.chat import digest_conversations, format_conversations
    out = digest_conversations(format_conversations(turns))
elif which == "classifiers":
    from tessera.llm.quality_classifier import score_quality
    from tessera.llm.toxicity import score_toxicity
    assert score_quality(docs, labels, ["doc_id"]).count() == 8
    out = score_toxicity(docs, labels)
elif which == "lm_scoring":
    from tessera.llm.lm_scoring import score_texts
    out = score_texts(docs)
elif which == "divergence":
    from tessera.llm.divergence import divergences
    out = divergences(docs.selectExpr("text", "'en' AS lang", "concat('s', doc_id % 2) AS source")).where("part = 'pair'")
elif which == "importance":
    from tessera.llm.importance import resample
    out = resample(docs, bench)
elif which == "main_text":
    from tessera.llm.main_text import main_texts
    out = main_texts(pages)
else:
    from tessera.llm.warc import read_warc, write_warc
    write_warc(pages, sys.argv[2] + "/w")
    out = read_warc(spark, "file://" + sys.argv[2] + "/w")
print("ROWS", len(out.collect()))
"""
EXPECTED = {"quality_rules": 8, "near_dups": 8, "repeats": 8, "decontamination": 8, "chat": 1, "classifiers": 8, "lm_scoring": 8, "divergence": 2, "importance": 8, "main_text": 2, "warc": 2}


def test_each_operator_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "script.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}

    def run(which):
        folder = tmp_path / which
        folder.mkdir()
        return subprocess.run([sys.executable, str(script), root, str(folder), which], cwd=folder, env=env, capture_output=True, text=True, timeout=400)

    with ThreadPoolExecutor(3) as pool:
        for which, done in zip(EXPECTED, pool.map(run, EXPECTED)):
            assert f"ROWS {EXPECTED[which]}" in done.stdout, which + done.stdout[-500:] + done.stderr[-3000:]
