import io
import json
import os
import subprocess
import sys
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import datasources, parsers
from tests.test_sources_and_hooks import W, packed, para


@pytest.fixture
def known(spark):
    datasources.register(spark)
    parsers.register(spark)
    return spark


def archives(folder):
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("x/", b"")
        for k in range(20):
            z.writestr(f"x/{k}.txt", b"t" * k)
    with tarfile.open(folder / "b.tar.gz", "w:gz") as t:
        for name in ("y.md", "z.txt"):
            i = tarfile.TarInfo(name)
            i.size = 4
            t.addfile(i, io.BytesIO(b"# yz"))
    (folder / "bad.zip").write_bytes(b"no archive")
    (folder / "_hidden.zip").write_bytes(b"no archive")
    (folder / "other.txt").write_bytes(b"no archive")


def test_archives(known, tmp_path):
    archives(tmp_path)
    read = known.read.format("tessera_archive")
    rows = read.load(str(tmp_path)).collect()
    assert len(rows) == 23 and sorted(r.size for r in rows if r.size is not None) == sorted([*range(20), 4, 4])
    assert [(r.path.rsplit("/", 1)[1], r.member) for r in rows if r.error] == [("bad.zip", None)] and all(len(r.content) == r.size for r in rows if r.size is not None)
    picked = read.load(str(tmp_path)).where(F.endswith("member", F.lit("7.txt")) & (F.col("size") >= 7))
    assert sorted(r.member for r in picked.collect()) == ["x/17.txt", "x/7.txt"]
    assert "EndsWith" not in picked._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    bare = read.option("content", "false").load(str(tmp_path)).where("member IS NOT NULL")
    assert bare.count() == 22 and bare.where("content IS NOT NULL").count() == 0
    assert read.option("partitionBytes", 1).load(str(tmp_path)).rdd.getNumPartitions() == 3
    (tmp_path / "none").mkdir()
    assert read.load(str(tmp_path / "none")).count() == 0


def test_filters_reach_the_reader():
    r = datasources.ArchiveReader({"path": "/x"})
    from pyspark.sql.datasource import EqualTo, In, IsNull, StringStartsWith

    left = list(r.pushFilters([StringStartsWith(("member",), "x"), IsNull(("member",)), EqualTo(("error",), "e"), In(("size",), [1, 2])]))
    assert [type(f).__name__ for f in left] == ["IsNull", "EqualTo"]
    assert r.passes(member="xy", size=2) and not r.passes(member="y", size=2) and not r.passes(member="x", size=3) and not r.passes(member=None, size=None)


def test_archives_are_written_whole_or_not_at_all(known, tmp_path):
    rows = known.range(50).repartition(3).select(F.format_string("%d.bin", "id").alias("member"), F.repeat(F.lit("ab"), F.col("id").cast("int")).cast("binary").alias("content"))
    out = str(tmp_path / "out")
    rows.write.format("tessera_archive").mode("append").option("archiveBytes", 500).save(out)
    back = known.read.format("tessera_archive").load(out)
    assert {(r.member, bytes(r.content)) for r in back.collect()} == {(f"{k}.bin", b"ab" * k) for k in range(50)}
    names = os.listdir(out)
    assert len(names) > 3 and all(n.startswith("part-") for n in names)
    with pytest.raises(Exception):
        rows.withColumn("member", F.when(F.col("member") == "49.bin", F.raise_error(F.lit("no"))).otherwise(F.col("member"))).write.format("tessera_archive").mode("append").save(out)
    assert sorted(os.listdir(out)) == sorted(names)
    with pytest.raises(Exception, match="append"):
        rows.write.format("tessera_archive").mode("overwrite").save(out)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_spans_hold_each_line_once(tmp_path, size, end):
    lines = ["query-id\tcorpus-id\tscore", *(f"q{k}\tdé{k}\t{k % 3}" for k in range(30)), ""]
    (tmp_path / "a.tsv").write_bytes(end.join(lines).encode())
    (tmp_path / "b.jsonl").write_bytes(("﻿" + end.join(json.dumps({"qid": k, "pid": f"p{k}", "relevance": 1}) for k in range(9))).encode())
    (tmp_path / "c.jsonl").write_bytes(b"")
    r = datasources.JudgmentReader({"path": str(tmp_path), "partitionBytes": size})
    got = [tuple(row.values()) for p in r.partitions() for b in r.read(p) for row in b.to_pylist()]
    assert sorted(got) == sorted([*((f"q{k}", f"dé{k}", k % 3) for k in range(30)), *((str(k), f"p{k}", 1) for k in range(9))])


def test_judgments(known, tmp_path):
    (tmp_path / "a.tsv").write_text("query_id\tdoc_id\tscore\trelevance\nq\td\t0\t2\nq\te\tx\t\nr\td\t1\t5\n")
    rows = known.read.format("tessera_judgments").load(str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("q", "d", 2), ("q", "e", 0), ("r", "d", 1)]
    assert [tuple(x) for x in rows.where("query_id = 'q' AND relevance > 0").collect()] == [("q", "d", 2)]
    (tmp_path / "b.jsonl").write_text('{"qid": 1}\n')
    with pytest.raises(Exception, match="a judgment has no doc_id"):
        known.read.format("tessera_judgments").load(str(tmp_path)).collect()


def test_files_by_their_parsers(known, tmp_path):
    docx = packed(word__document_xml=f'<w:document xmlns:w="{W}"><w:body>{para("One", "Heading1")}{para("x")}</w:body></w:document>')
    contents = {"d.docx": docx, "m.MD": b"# T\nlead\n## S\n\xffx", "p.html": b"<title>P</title><p>said", "t.txt": b"\xef\xbb\xbfa\r\nb", "e.txt": b"", "i.png": b"x", "bad.docx": b"x", "noname": b"x"}
    for name, c in contents.items():
        (tmp_path / name).write_bytes(c)
    files = known.read.format("binaryFile").load(str(tmp_path))
    found = {}
    for r in parsers.parse_files(files, {"image": lambda content, location: [{"order_index": 0, "toc_path": [], "level": 1, "kind": "ocr_region", "section_text": "seen"}]}).orderBy("path", "order_index").collect():
        found.setdefault(r.path.rsplit("/", 1)[1], []).append((r.section_text, r.error and r.error.split(":")[0]))
    assert found == {"d.docx": [("x", None)], "m.MD": [("lead", None), ("�x", None)], "p.html": [("said", None)], "t.txt": [("a\nb", None)], "i.png": [("seen", None)], "bad.docx": [(None, "BadZipFile")], "noname": [(None, "no parser for this type")]}
    blank = known.createDataFrame([("x/e.txt", None), (None, b"y")], "path string, content binary")
    assert {(r.path, r.section_text, r.error) for r in parsers.parse_files(blank).collect()} == {("x/e.txt", "e", None), (None, None, "no parser for this type")}
    office = known.read.format("tessera_office").load(str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.section_text) for r in office.collect()} == {("d.docx", "x"), ("bad.docx", None)}
    assert [r.section_text for r in office.where(F.endswith("path", F.lit("/d.docx"))).collect()] == ["x"]
    files.createOrReplaceTempView("parsed_files")
    sql = "SELECT f.path, s.* FROM (SELECT * FROM parsed_files WHERE path LIKE '%d.docx' AND path NOT LIKE '%bad%') f, LATERAL file_sections(f.content, f.path, 'docx') s"
    assert [(r.toc_path, r.section_text) for r in known.sql(sql).collect()] == [(["One"], "x")]
    assert known.sql("SELECT text FROM markdown_blocks(NULL, NULL)").collect()[0].text == "document"
    known.catalog.dropTempView("parsed_files")


SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from tessera.sources import datasources, parsers
datasources.register(spark)
parsers.register(spark)
spark.createDataFrame([("a.md", b"# A")], "member string, content binary").write.format("tessera_archive").mode("append").save(sys.argv[2])
back = spark.read.format("tessera_archive").load(sys.argv[2])
assert parsers.parse_files(back.select(back.member.alias("path"), "content")).collect()[0].section_text == "A"
assert spark.sql("SELECT text FROM markdown_blocks('a', 'b')").count() == 2
"""


def test_workers_elsewhere_find_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, root, str(tmp_path / "out")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-3000:]
