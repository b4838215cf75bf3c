"""Assets near sections against a loop over all elements; counts of models, retried tasks included."""

import os
import random
import subprocess
import sys

from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.operators import layout
from tessera.operators.telemetry import Telemetry


def loops(sections, elements, assets):
    out, by_ref = [], {(d, str(r)): a for d, a, r in assets if r and str(r).strip()}
    is_asset = lambda k: (k or "").strip().lower() in layout.ASSET_KINDS
    clean = lambda p: [x for x in p or [] if x.strip()]
    for sid, doc, path, a, b in sections:
        lo, hi = (a if a is not None else b), (b if b is not None else a)
        pages = set() if lo is None else {p for p in range(min(lo, hi), max(lo, hi) + 1) if p > 0}
        best = {}
        for d, ref, kind, epath, page, box in elements:
            asset = by_ref.get((d, ref))
            if d != doc or not is_asset(kind) or asset is None or page is None or not (clean(epath) == clean(path) or page in pages):
                continue
            texts = [t for t in elements if t[0] == doc and not is_asset(t[2]) and clean(t[3]) == clean(path) and t[4] == page and page in pages and t[5]]
            gap = min((abs(box[1] - t[5][3]) for t in texts), default=float("inf")) if box else float("inf")
            key = (clean(epath) != clean(path), gap, abs(page - min(pages or {page})))
            best[asset] = min(best.get(asset, key), key)
        out += [(sid, x, k) for k, (_, x) in enumerate(sorted((v, x) for x, v in best.items()), 1)]
    return sorted(out)


def test_section_assets_are_those_of_plain_loops(spark):
    rng = random.Random(12)
    paths = [["a"], ["a", "b"], ["a", " "], None]
    sections = [(i, rng.randrange(3), rng.choice(paths), rng.choice([None, 1, 2, 4]), rng.choice([None, 1, 3])) for i in range(24)]
    elements = []
    for i in range(300):
        y = rng.randrange(0, 60) / 2
        elements.append((rng.randrange(3), f"e{i}", rng.choice(["Table", "figure ", "text", None, "list"]), rng.choice(paths), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([None, [0.0, y, 1.0, y + rng.randrange(1, 9)]])))
    assets = [(d, 1000 + i, e) for i, (d, e, k, *_) in enumerate(elements) if rng.random() < 0.8] + [(0, 5000, " "), (0, 5001, None)]
    found = layout.section_assets(
        spark.createDataFrame(sections, "section_id long, doc_id long, toc_path array<string>, page_start int, page_end int"),
        spark.createDataFrame(elements, "doc_id long, element_id string, kind string, toc_path array<string>, page_no int, bbox array<double>"),
        spark.createDataFrame(assets, "doc_id long, asset_id long, element_ref string"),
    )
    assert sorted((r.section_id, r.asset_id, r.place) for r in found.collect()) == loops(sections, elements, assets)


def test_a_hot_page_is_swept(spark):
    n = 100_000
    tops = spark.range(n).select(F.lit(1).alias("page"), (F.col("id") * 7 % 99991).cast("double").alias("y"))
    bottoms = spark.range(n).select(F.lit(1).alias("page"), (F.col("id") * 11 % 99991 + 0.25).alias("y"))
    out = layout.nearest(tops, bottoms, ["page"]).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("most")).first()
    assert out.n == n and out.most <= 0.75


class Model:
    def generate_text(self, prompt):
        if prompt.endswith("3"):
            raise ValueError("three")
        return prompt

    def embed(self, texts):
        return [[1.0] for _ in texts]


def test_counts_are_exact(spark):
    seen = Telemetry(spark)
    say, embed = hooks.told(seen.watched(Model, "chat", "m")), hooks.embedder(seen.watched(Model, "embedding"))
    docs = seen.stage(spark.range(100).select(F.concat(F.lit("t"), F.col("id")).alias("t")).repartition(4), "in", longest=F.max(F.length("t")))
    errors = sum(r.s.error is not None for r in docs.select(say("t").alias("s"), embed("t").alias("v")).collect())
    got = {r.capability: r for r in seen.report().collect()}
    assert errors == 10 and (got["chat"].calls, got["chat"].texts, got["chat"].errors) == (100, 100, 10) and got["chat"].ms > 0
    assert (got["embedding"].texts, got["embedding"].errors) == (100, 0) and 4 <= got["embedding"].calls < 100
    assert seen.stages() == [{"stage": "in", "rows": 100, "longest": 3}]
    seen.reset()
    assert seen.report().count() == 0


RETRIED = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from pyspark import TaskContext
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from tessera.functions import hooks
from tessera.operators.telemetry import Telemetry
from tessera.operators.tables import detect_headers

class Fails:
    def __init__(self):
        self.n = 0
    def embed(self, texts):
        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
            self.n += 1
            if self.n > 1:
                raise RuntimeError("the first attempt is lost after a batch")
        return [[1.0] for _ in texts]

spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
seen = Telemetry(spark)
rows = spark.range(0, 80, 1, 2).select(hooks.embedder(seen.watched(Fails, "embedding"))(F.col("id").cast("string")).alias("v")).collect()
r = seen.report().first()
sheets = spark.createDataFrame([(1, [["Name", "Age"], ["Ann", "3"]])], "sheet_id long, rows array<array<string>>")
print("GOT", len(rows), r.calls, r.texts, r.errors, detect_headers(sheets).count())
"""


def test_a_retried_task_counts_once_and_hooks_ship_themselves(tmp_path):
    (tmp_path / "script.py").write_text(RETRIED)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "script.py", root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GOT 80 8 80 0 1" in out.stdout, out.stdout + out.stderr[-2000:]
